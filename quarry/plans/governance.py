"""Read-only gate, row scope by scoped views, limits, redaction and definition checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterated import descendants
from .analysed import Lineage, analysed, strange

ROW_CAP = 200
#: Parts of column names whose values are never shown.
SENSITIVE = ("password", "passwd", "secret", "token", "id_card", "phone", "mobile")


class GateError(ValueError):
    pass


class ScopeError(ValueError):
    pass


#: The functions that a statement may call. All others are refused, above all those that run code.
FUNCTIONS = frozenset("""
abs acos asin atan atan2 cbrt ceil ceiling cos degrees exp floor greatest least ln log log10 log2 mod negative pmod pow power radians rand
round bround sign signum sin sqrt tan truncate
avg mean count count_if sum min max min_by max_by first last any every some bool_and bool_or stddev stddev_pop stddev_samp variance var_pop var_samp
corr covar_pop covar_samp median mode percentile percentile_approx approx_percentile approx_count_distinct collect_list collect_set array_agg listagg string_agg
row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value cume_dist
char_length character_length length lower lcase upper ucase trim ltrim rtrim lpad rpad substr substring left right replace translate reverse repeat
concat concat_ws instr locate position split split_part regexp_replace regexp_extract regexp_like rlike startswith endswith contains initcap format_number
coalesce ifnull nvl nvl2 nullif if isnull isnotnull isnan
current_date date_add date_sub dateadd datediff date_diff date_format date_trunc trunc to_date to_timestamp make_date add_months months_between last_day
year quarter month day dayofmonth dayofweek dayofyear weekofyear hour minute second extract date_part unix_timestamp from_unixtime timestampdiff window
between like ilike not and or isnotdistinctfrom cast string int bigint double decimal boolean date timestamp array map struct named_struct size array_contains explode element_at get_json_object
""".split())


@dataclass(frozen=True)
class Raw:
    """A statement as it came."""

    sql: str


@dataclass(frozen=True)
class Checked:
    """A statement that the gate let through, with the relations it reads; made by check() alone."""

    sql: str
    names: frozenset[str]


@dataclass(frozen=True)
class Scoped:
    """A checked statement with the session in which its relations are views of a principal's rows; made by scope() alone."""

    sql: str
    session: SparkSession
    tables: frozenset[str]


@dataclass
class Result:
    """A bounded result with its integrity flags."""

    df: DataFrame
    redacted: list[str] = field(default_factory=list)
    truncated: bool = False


def elements(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the relations that one read-only statement reads; raises GateError for anything else.

    The statement is parsed by Spark, and its unresolved plan is walked; commands are refused, and so are functions
    that aren't in the list and names that are made up by IDENTIFIER(). A name is a CTE only where that CTE can be
    seen: not in its own body unless it is recursive, nor in those before it, nor outside of the query that it
    belongs to. What the names turn out to be is proven by run_scoped() on the analysed plan.
    """
    if re.search(r"/\*[!+]", sql):
        raise GateError("executable comments are refused")
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", sql), flags=re.S)
    if re.search(r"[?]|(?<!:):[A-Za-z_]+\b", plain):
        raise GateError("unbound placeholders are refused")
    if re.search(r"\bidentifier\s*\(", plain, re.I):
        raise GateError("names made up by identifier() are refused")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GateError(f"not one statement that parses: {str(e).splitlines()[0]}") from None
    names: set[str] = set()

    def calls(expression):
        kind = expression.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:
            raise GateError("names made up by identifier() are refused")
        if kind == "UnresolvedFunction":
            name = ".".join(elements(expression.nameParts())).lower()
            if name not in FUNCTIONS:
                raise GateError(f"the function {name} is refused")
        for e in elements(expression.children()):
            calls(e)

    def walk(node, visible: frozenset):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            name = node.tableName().replace("`", "").lower()
            if name not in visible:
                names.add(name)
        elif kind == "UnresolvedWith":
            for cte in elements(node.cteRelations()):
                walk(cte._2(), visible | {cte._1().lower()} if node.allowRecursion() else visible)
                visible = visible | {cte._1().lower()}
        elif re.search("Command|Insert|Create|Drop|Alter|Merge|Delete|Update|Replace|Truncate|SetCatalog|UnresolvedTableValuedFunction|UnresolvedIdentifier|ScriptTransformation|Show|Describe|Cache|Refresh", kind):
            raise GateError(f"{kind} is not a read")
        for e in elements(node.expressions()):
            calls(e)
        for inner in (*elements(node.subqueries()), *elements(node.children())):
            walk(inner, visible)

    walk(plan, frozenset())
    if not names:
        raise GateError("a statement that reads no table is refused")
    if bad := [n for n in names if n.split(".")[0] in ("information_schema", "mysql", "pg_catalog", "sys", "system")]:
        raise GateError(f"system tables are refused: {bad}")
    return names


def check(spark: SparkSession, raw: Raw) -> Checked:
    return Checked(raw.sql, frozenset(relations(spark, raw.sql)))


@dataclass(frozen=True)
class Binding:
    """How rows of a table belong to a principal: by a customer or owner column, through a header, or to everyone."""

    kind: str = "scoped"  # scoped, global, via
    customer_col: str | None = None
    owner_col: str | None = None
    via_table: str | None = None
    via_col: str | None = None
    via_key: str | None = None


@dataclass(frozen=True)
class Unrestricted:
    """Proof that a login sees everything: it takes two facts that don't come from one place."""

    login: str
    view_type_all: bool
    role_admin: bool

    def __post_init__(self):
        if not (self.view_type_all and self.role_admin):
            raise ScopeError(f"{self.login} isn't proven to be unrestricted")


@dataclass(frozen=True)
class Principal:
    """Whose rows are read: those of the customers and of the owners named, and no others.

    None and an empty tuple name nobody. Every row is seen only with a proof of the same login.
    """

    login: str
    customers: tuple | None = None
    owners: tuple | None = None
    proof: Unrestricted | None = None

    def __post_init__(self):
        if self.proof and self.proof.login != self.login:
            raise ScopeError(f"the proof is of {self.proof.login} and not of {self.login}")

    @property
    def unrestricted(self) -> bool:
        return isinstance(self.proof, Unrestricted)


def scoped(table: str, tables, bindings: dict[str, Binding], who: Principal) -> DataFrame:
    """The rows of a table that a principal may see; a table without a binding is refused."""
    if table not in bindings:
        raise ScopeError(f"{table} has no scope binding")
    b, df = bindings[table], tables(table)
    if b.kind == "global" or who.unrestricted:
        return df
    if b.kind == "via":
        header = scoped(b.via_table, tables, bindings, who).select(F.col(b.via_key).alias("_k"))
        return df.join(header, df[b.via_col] == header["_k"], "left_semi")
    cond = F.lit(False)
    if b.owner_col and who.owners:
        cond = cond | F.col(b.owner_col).isin(*who.owners)
    if b.customer_col and who.customers:
        cond = cond | F.col(b.customer_col).isin(*who.customers)
    return df.where(cond)


def scope(spark: SparkSession, checked: Checked, tables, bindings: dict[str, Binding], who: Principal) -> Scoped:
    """A session of its own in which every relation of the statement is a view of the rows that a principal may see."""
    session = spark.newSession()
    for n in checked.names:
        if "." in n:
            raise ScopeError(f"{n} is named by its catalogue, which no scope covers")
        scoped(n, lambda t: tables(session, t), bindings, who).createOrReplaceTempView(n)
    return Scoped(checked.sql, session, checked.names)


def opened(stage: Scoped) -> DataFrame:
    """The statement's rows, once its analysed plan is proven to read the scoped views and nothing else."""
    try:
        df = stage.session.sql(stage.sql)
    except PySparkException as e:
        raise GateError(f"not a statement of these tables: {str(e).splitlines()[0]}") from None
    if bad := strange(df, stage.tables):
        raise GateError(f"{bad[0]} is refused")
    return df


def run_scoped(spark: SparkSession, sql: str, tables, bindings: dict[str, Binding], who: Principal, cap: int = ROW_CAP, sensitive: tuple[str, ...] = SENSITIVE) -> Result:
    """Gates the statement, gives its relations scoped views in a session of its own, proves on the analysed plan that it
    reads nothing else, nulls what comes from sensitive columns, runs it, and caps the rows."""
    stage = scope(spark, check(spark, Raw(sql)), tables, bindings, who)
    return bounded(redact(opened(stage), stage.tables, sensitive), cap)


def redact(df: DataFrame, tables: frozenset[str] | None = None, sensitive: tuple[str, ...] = SENSITIVE) -> Result:
    """Columns that come from sensitive ones, through whatever expressions and names, become null and are named.

    A column is sensitive if its name holds one of the words. Columns that only carry such a name count as well. Of a
    statement over scoped tables, one that chooses, joins, groups or orders rows by a sensitive column is refused,
    since the rows would tell its values.
    """
    hidden = lambda name: any(s in name.lower() for s in sensitive)
    lineage = Lineage(analysed(df), set(tables) if tables is not None else None)
    if tables is not None:
        for place, o in lineage.tested():
            if bad := sorted(c for _, c in o.sources if hidden(c)):
                raise GateError(f"rows may not be told apart by {bad[0]} ({place})")
    origins = lineage.columns()
    if len(origins) != len(df.columns):
        raise GateError("the origins of the result's columns aren't known")
    at = [k for k, (c, o) in enumerate(zip(df.columns, origins)) if hidden(c) or any(hidden(x) for _, x in o.sources)]
    if not at:
        return Result(df)
    names = [f"_c{k}" for k in range(len(df.columns))]
    flat = df.toDF(*names)
    shown = [F.lit(None).cast(f.dataType).alias(n) if k in at else F.col(n) for k, (n, f) in enumerate(zip(names, df.schema.fields))]
    return Result(flat.select(*shown).toDF(*df.columns), [df.columns[k] for k in at])


def bounded(result: Result, cap: int) -> Result:
    """At most cap rows of one run, and whether there were more: found with one row beyond the cap, so that rows and flag agree."""
    got = result.df.limit(cap + 1).collect()
    return Result(result.df.sparkSession.createDataFrame(got[:cap], result.df.schema), result.redacted, len(got) > cap)


def clamp(asked: int | None, *limits: int) -> int:
    """A limit that policies can only tighten: the least of what is asked for and of each policy's, one at least."""
    return max(1, min([x for x in (asked, *limits) if x is not None]))


def merge_codes(*lists: list | None) -> tuple | None:
    """Codes of several grants: an empty or missing list is no restriction, and -1 alone denies (an empty tuple)."""
    if any(not x for x in lists):
        return None
    return tuple(sorted({c for x in lists for c in x if str(c) != "-1"}, key=str))


class ScopeCache:
    """Principals by login, role, source and the version of the rules; a new version forgets the old ones of its key."""

    def __init__(self, load, most: int = 10_000):
        self.load, self.most, self.held = load, most, {}

    def get(self, login: str, role: str, source: str, version: str) -> Principal:
        key = (login, role, source)
        if self.held.get(key, (None,))[0] != version:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[key] = (version, self.load(*key))
        return self.held[key][1]


def decide_scope(view_types: list[str], login: str, own: tuple, department: tuple, customers: tuple, tree: tuple | None = None, admin: bool = False) -> Principal:
    """The widest of a login's view types; none of them, or an unknown one, is an error.

    The view type "all" alone proves nothing: the login's role must be an administrator's too. tree has the owners at or below the login's departments, as expand_tree() finds them.
    """
    order = ("self", "department", "tree", "settlement", "all")
    if bad := set(view_types) - set(order) or not view_types:
        raise ScopeError(f"no known view type: {bad if isinstance(bad, set) else None}")
    widest = max(view_types, key=order.index)
    if widest == "all":
        return Principal(login, proof=Unrestricted(login, True, admin))
    return {"self": Principal(login, owners=own), "department": Principal(login, owners=department), "tree": Principal(login, owners=tree if tree is not None else department), "settlement": Principal(login, customers=customers)}[widest]


def expand_tree(nodes: DataFrame, roots: list) -> DataFrame:
    """Departments (id, parent) at or below the roots, on Spark alone; cycles end, see descendants()."""
    return descendants(nodes, F.col("id").isin(*roots))
