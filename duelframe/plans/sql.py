"""Ad-hoc SQL over the tables: read-only, by what the statement is rather than by words in it."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
ROWS = 200

_PLANS = "org.apache.spark.sql.catalyst.plans.logical"
_ANALYSIS = "org.apache.spark.sql.catalyst.analysis"
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"
#: Built-in functions that reach beyond the tables: methods of any class, and names of the session, its files and its host.
REFUSED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length version current_user session_user user current_database current_schema current_catalog raise_error assert_true sleep".split())
#: Table functions over rows that the statement itself has.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(str(PurePosixPath(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def fault(spark: SparkSession, statement: str) -> str | None:
    """Why the parsed statement may not run: a command anywhere in its plan, or a function that isn't a built-in one or is
    refused, at any depth (in subqueries, common tables, lambdas, windows and arguments too). None if it may."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    load = plan.getClass().getClassLoader().loadClass
    command = [load(f"{_PLANS}.{n}") for n in ("Command", "ParsedStatement")]
    function, table_function, subquery = load(f"{_ANALYSIS}.UnresolvedFunction"), load(f"{_ANALYSIS}.UnresolvedTableValuedFunction"), load(f"{_EXPRESSIONS}.PlanExpression")
    with_tables, generate = load(f"{_PLANS}.UnresolvedWith"), load(f"{_ANALYSIS}.UnresolvedGenerator")
    known = {r["function"] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - REFUSED  # some 500 names

    def called(parts, allowed: frozenset | set) -> str | None:
        names = [str(p).lower() for p in parts]
        return None if len(names) == 1 and names[0] in allowed else f"function {'.'.join(names)}"

    plans, expressions = [plan], []
    while plans or expressions:
        if plans:
            node = plans.pop()
            if any(kind.isInstance(node) for kind in command):
                return "not a query"
            if table_function.isInstance(node) and (why := called(_each(node.name()), TABLE_FUNCTIONS)):
                return why
            if with_tables.isInstance(node):
                plans += [r._2() for r in _each(node.cteRelations())]
            plans += _each(node.children())
            expressions += _each(node.expressions())
        else:
            node = expressions.pop()
            if function.isInstance(node) and (why := called(_each(node.nameParts()), known)):
                return why
            if generate.isInstance(node) and (why := called([node.name().funcName()], TABLE_FUNCTIONS)):
                return why
            if subquery.isInstance(node):
                plans.append(node.plan())
            expressions += _each(node.children())
    return None


def query(spark: SparkSession, statement: str, rows: int = ROWS) -> DataFrame:
    """A query over registered tables, up to `rows` rows. It is analyzed in a copy of the session where files can't be named, so neither
    the caller's settings nor other threads are touched."""
    why = fault(spark, statement)
    if why:
        raise ValueError(f"only queries are allowed: {why}")
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    return own.sql(statement).limit(rows)


_SQL = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_orderstatus <> 'update' GROUP BY o_orderpriority"


def ad_hoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("orders",))
    return query(spark, _SQL)


QUERIES = {"ad_hoc_sql": ad_hoc_sql}
ORACLES = {"ad_hoc_sql": _SQL}
