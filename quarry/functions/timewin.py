"""Time phrases to half-open windows, and windows to compare with; today is always an argument."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from ..plans.model import TimeWindow

#: Numerals.
DIGITS = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"两": 2}


def cn_num(s: str) -> int | None:
    """Decimal or Chinese numerals up to 99."""
    if s.isdigit():
        return int(s)
    if "十" in s:
        tens, ones = s.split("十", 1)
        if all(x == "" or x in DIGITS for x in (tens, ones)):
            return DIGITS.get(tens, 1) * 10 + DIGITS.get(ones, 0)
        return None
    return DIGITS.get(s)


def add_months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def month0(d: date) -> date:
    return d.replace(day=1)


def quarter0(d: date) -> date:
    return date(d.year, (d.month - 1) // 3 * 3 + 1, 1)


def week0(d: date) -> date:
    return d - timedelta(d.weekday())


def days(a: date, n: int = 1) -> TimeWindow:
    return TimeWindow(a, a + timedelta(n))


def months(a: date, n: int) -> TimeWindow:
    return TimeWindow(a, add_months(a, n))


NUM = r"(\d{1,2}|[一二两三四五六七八九十]{1,3})"


def year_of(q: str, today: date) -> int:
    if m := re.search(r"(?<!\d)((?:19|20)\d\d)(?!\d)", q):
        return int(m[1])
    return today.year - 1 if re.search("去年|last year", q) else today.year


def explicit(q: str, today: date) -> TimeWindow | None:
    found = re.findall(r"((?:19|20)\d\d)[-/.年](\d{1,2})[-/.月](\d{1,2})日?", q)
    if len(found) != 2:
        return None
    try:
        a, b = (date(*map(int, x)) for x in found)
    except ValueError:
        return None
    return TimeWindow(a, b + timedelta(1)) if a <= b else None


def recent(q: str, today: date) -> TimeWindow | None:
    m = re.search(r"(?:last|past|最近|近|过去)\s*" + NUM + r"\s*(?:个)?(day|week|month|year|天|日|周|星期|月|年)s?", q)
    n = cn_num(m[1]) if m else None
    if not n or not 1 <= n <= 60:
        return None
    end, unit = today + timedelta(1), m[2]
    if unit in ("day", "天", "日"):
        return TimeWindow(end - timedelta(n), end)
    if unit in ("week", "周", "星期"):
        return TimeWindow(end - timedelta(7 * n), end)
    return TimeWindow(add_months(today, -n * (12 if unit in ("year", "年") else 1)) + timedelta(1), end)


def quarter(q: str, today: date) -> TimeWindow | None:
    y = date(year_of(q, today), 1, 1)
    if m := re.search(r"(?:first|前)\s*" + NUM + r"\s*(?:个)?(?:quarters?|季度)", q):
        n = cn_num(m[1])
        return months(y, 3 * n) if n and n <= 4 else None
    if m := re.search(r"[qQ]([1-4])\b|第?([一二三四1-4])季度", q):
        return months(add_months(y, 3 * (cn_num(m[1] or m[2]) - 1)), 3)
    if re.search("last quarter|上个?季度", q):
        return months(add_months(quarter0(today), -3), 3)
    return months(quarter0(today), 3) if re.search("this quarter|本季度|这个季度", q) else None


def half(q: str, today: date) -> TimeWindow | None:
    y = date(year_of(q, today), 1, 1)
    if re.search("first half|上半年", q):
        return months(y, 6)
    return months(add_months(y, 6), 6) if re.search("second half|下半年", q) else None


def month(q: str, today: date) -> TimeWindow | None:
    if m := re.search(r"((?:19|20)\d\d)-(\d{1,2})(?![-\d])", q):
        return months(date(int(m[1]), int(m[2]), 1), 1) if 1 <= int(m[2]) <= 12 else None
    m = re.search(r"(?<![个近])" + NUM + r"月(?!内|以来)", q)
    n = cn_num(m[1]) if m else None
    return months(date(year_of(q, today), n, 1), 1) if n and n <= 12 else None


def relative(q: str, today: date) -> TimeWindow | None:
    m0, w0 = month0(today), week0(today)
    for pattern, window in (
        ("day before yesterday|前天", days(today - timedelta(2))), ("yesterday|昨天|昨日", days(today - timedelta(1))), ("today|今天|今日", days(today)),
        ("this month|本月|这个月", months(m0, 1)), ("last month|上个?月", months(add_months(m0, -1), 1)),
        ("this week|本周|这周", days(w0, 7)), ("last week|上周", days(w0 - timedelta(7), 7)),
        ("this year|今年|本年", months(date(today.year, 1, 1), 12)), ("last year|去年", months(date(today.year - 1, 1, 1), 12)),
    ):
        if re.search(pattern, q):
            return window
    return None


def year(q: str, today: date) -> TimeWindow | None:
    m = re.search(r"(?<!\d)((?:19|20)\d\d)(?:年|(?![-/.\d]))", q)
    return months(date(int(m[1]), 1, 1), 12) if m else None


def parse(q: str, today: date) -> TimeWindow | None:
    """The first rule that reads the phrase: explicit range, recent units, quarter, half, month, year, relative."""
    for rule in (explicit, recent, quarter, half, month, year, relative):
        if w := rule(q, today):
            return w
    return None


def to_date(w: TimeWindow, today: date, q: str = "") -> TimeWindow:
    """A window that has begun ends after today at the latest, but for a month, quarter or year that is named outright."""
    named = re.search(r"(?<!\d)(?:19|20)\d\d|\d{1,2}月|[qQ][1-4]\b|[一二三四1-4]季度", q)
    return w if named or w.begin > today else TimeWindow(w.begin, min(w.end, today + timedelta(1)))


#: Periods to compare, by the words for them: start of the current one, and its length in months (0: days).
CURRENT = (("today|今天|今日", lambda d: d, 0, 1), ("this week|本周|这周", week0, 0, 7), ("this month|本月|这个月", month0, 1, 0), ("this quarter|本季度|这个季度", quarter0, 3, 0), ("this year|今年|本年", lambda d: date(d.year, 1, 1), 12, 0))
PAST = (("day before yesterday|前天", lambda d: d - timedelta(2), 0, 1), ("yesterday|昨天|昨日", lambda d: d - timedelta(1), 0, 1), ("last week|上周", lambda d: week0(d) - timedelta(7), 0, 7), ("last month|上个?月", lambda d: add_months(month0(d), -1), 1, 0), ("last quarter|上个?季度", lambda d: add_months(quarter0(d), -3), 3, 0), ("last year|去年", lambda d: date(d.year - 1, 1, 1), 12, 0))


def previous(q: str, today: date, inclusive: bool = False) -> TimeWindow | None:
    """The window before, as far along as this one; a past period's is the whole one before. None if neither is named."""
    for words, start, n, d in PAST:
        if re.search(words, q):
            begin = start(today)
            return days(begin - timedelta(d), d) if d else months(add_months(begin, -n), n)
    for words, start, n, d in CURRENT:
        if re.search(words, q):
            begin, end = start(today), today + timedelta(1 if inclusive else 0)
            if d:
                return TimeWindow(begin - timedelta(d), end - timedelta(d))
            return TimeWindow(add_months(begin, -n), add_months(today, -n) + timedelta(1 if inclusive else 0))
    return None


def year_ago(q: str, today: date, inclusive: bool = False) -> TimeWindow | None:
    """The same window a year before, as far along; weeks and days of them go back 364 days, so that weekdays agree."""
    for words, start, n, d in PAST:
        if re.search(words, q):
            begin = start(today)
            return days(begin - timedelta(364), 7) if d == 7 else days(add_months(begin, -12), d) if d else months(add_months(begin, -12), n)
    for words, start, n, d in CURRENT:
        if re.search(words, q):
            more = timedelta(1 if inclusive else 0)
            if d == 7:
                return TimeWindow(start(today) - timedelta(364), today - timedelta(364) + more)
            return TimeWindow(add_months(start(today), -12), add_months(today, -12) + more)
    return None


def includes_today(q: str, today: date) -> bool:
    """Whether the window of a question takes in today, which metrics that end yesterday can't answer."""
    w = parse(q, today)
    return w is not None and w.begin <= today < w.end


#: Words for time, longest first where one holds another.
TIME_WORDS = ("day before yesterday", "yesterday", "today", "this week", "last week", "this month", "last month", "this quarter", "last quarter", "this year", "last year", "first half", "second half", "前天", "昨天", "昨日", "今天", "今日", "本周", "上周", "本月", "上个月", "上月", "本季度", "上季度", "今年", "去年", "上半年", "下半年")
NUMBERS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "百", "千", "万", "亿")


def time_tokens(q: str) -> set[str]:
    """The time words and dates of a question, each as far as it isn't part of a longer one."""
    out, rest = set(re.findall(r"(?:19|20)\d\d(?:[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?)?|[qQ][1-4]\b", q)), q
    for w in sorted(TIME_WORDS, key=len, reverse=True):
        if w in rest:
            out.add(w)
            rest = rest.replace(w, " ")
    return out


def time_phrase(q: str) -> str | None:
    """The part of a question that names its time: the longest run that parse() reads by itself."""
    found = [m[0] for p in (r"(?:19|20)\d\d[-/.年]\d{1,2}[-/.月]\d{1,2}日?.{1,5}(?:19|20)\d\d[-/.年]\d{1,2}[-/.月]\d{1,2}日?", r"(?:last|past|最近|近|过去)\s*" + NUM + r"\s*(?:个)?(?:days?|weeks?|months?|years?|天|日|周|月|年)", r"(?:第?[一二三四1-4]季度|[qQ][1-4])(?:\s*(?:19|20)\d\d)?", r"(?:(?:first|second) half of\s*)?(?:19|20)\d\d(?:-\d{1,2})?年?(?:\d{1,2}月)?") for m in re.finditer(p, q)]
    found += [w for w in TIME_WORDS if w in q]
    return max(found, key=len, default=None)


def inherit(q: str, before: str) -> str:
    """A follow-up question with the time phrase of the one before, where it names none itself."""
    phrase = time_phrase(before)
    return q if time_phrase(q) or not phrase else f"{q} {phrase}"


def partial_month(latest: str, today: date) -> str | None:
    """The month (yyyy-MM) of a series' latest period if it isn't over yet."""
    return latest if latest == f"{today:%Y-%m}" and (today + timedelta(1)).month == today.month else None


def weekly(today: date) -> dict[str, TimeWindow] | None:
    """This week up to yesterday, and as many days of the week before and of the same weekdays a year ago; None on Mondays,
    when the week has not begun to count."""
    n = (today - week0(today)).days
    if n == 0:
        return None
    return {"current_value": days(week0(today), n), "previous_value": days(week0(today) - timedelta(7), n), "year_ago_value": days(week0(today) - timedelta(364), n)}


def cap_at_yesterday(w: TimeWindow, today: date) -> TimeWindow:
    return TimeWindow(w.begin, min(w.end, today))


def top_n(q: str, default: int = 200) -> int:
    """N of 'top 5', 'lowest 3', '前十', '最低的3个'; counts of time units aren't ranks."""
    m = re.search(r"(?:top|best|first|lowest|worst|bottom|前|后|倒数)\s*" + NUM + r"(?!\s*(?:个)?(?:day|week|month|year|quarter|天|日|周|月|年|季度))|最[高低多少大小]的?" + NUM + r"个", q, re.I)
    n = cn_num(m[1] or m[2]) if m else None
    return n if n else default


def ascending(q: str) -> bool:
    return bool(re.search("lowest|worst|least|bottom|最低|最少|最差|倒数", q, re.I))
