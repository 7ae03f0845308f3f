"""Sequential ratings: recurrences that couple both sides of every bout, folded in order of time.

Each fold is one ordered pass over rows that are narrow (a bout has a handful of numbers), run for each
group that is independent: a rating pool. The default pool is the whole table, as one task; `pool` names a
column where pools don't meet (a league, a parameter set), and the folds of pools run in parallel. Spark sorts
the rows of a task, on disk where they outgrow its memory, and a fold reads them batch by batch: a worker holds a
batch and the ratings by entity, however many bouts there are.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duelframe.functions.text import division, method_category
from duelframe.session import workers_can_import
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

START = 1500.0
#: Fixed values.
K_BY_CLASS = {"finish": 40.0, "decision": 28.0, "other": 32.0}
CATEGORY_K = {"early_finish": 1.4, "late_finish": 1.2, "ud": 1.0, "majority": 0.9, "split": 0.75, "decision": 0.95}
NEWCOMER_BOUTS, NEWCOMER_K, BASE_K = 5, 60.0, 40.0
DECAY, FINISH_CREDIT, LOSS_SHARE, PASSES = 0.85, 1.3, 0.5, 5


def expected(a: float, b: float) -> float:
    return 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0))


#: Rows that a fold gives at a time.
BATCH = 4096


def _rows(batches):
    """Rows as tuples, in the order of the columns."""
    for b in batches:
        yield from zip(*[c.to_pylist() if c.null_count or not pa.types.is_floating(c.type) and not pa.types.is_integer(c.type) else c.to_numpy().tolist() for c in b.columns])


def by_rows(fold):
    """The fold of rows fold(iterator of tuples), which yields tuples, as a fold of batches."""

    def run(batches):
        found = fold(_rows(batches))
        while part := list(islice(found, BATCH)):
            yield zip(*part)

    return run


def _pieces(batches, at: int | None):
    """(value of the column at `at`, batch): batches cut where the value changes."""
    for b in batches:
        start = 0
        for value, own in groupby(b.column(at).to_pylist() if at is not None else [None] * min(b.num_rows, 1)):
            n = sum(1 for _ in own) if at is not None else b.num_rows
            yield value, b.slice(start, n)
            start += n


def _folded(fold, schema: pa.Schema, at: int | None):
    def run(batches):
        for _, own in groupby(_pieces(batches, at), key=lambda x: x[0]):
            for columns in fold(b for _, b in own):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def folded(df: DataFrame, fold, schema: str, pool: str | None = None) -> DataFrame:
    """fold(iterator of Arrow batches), which yields columns of `schema`, over each pool; all rows are one pool where none is named.

    Batches have df's columns but ts, in order of (ts, fight_id)."""
    workers_can_import(df.sparkSession)
    x = df.repartition(pool).sortWithinPartitions(pool, "ts", "fight_id") if pool else df.repartition(1).sortWithinPartitions("ts", "fight_id")
    x = x.drop("ts")
    return x.mapInArrow(_folded(fold, to_arrow_schema(StructType.fromDDL(schema)), x.columns.index(pool) if pool else None), schema)


@by_rows
def fold_elo(rows):
    """K by kind of result; a draw is half a win."""
    elo = defaultdict(lambda: START)
    for fight, r, b, winner, k in rows:
        red, blue = elo[r], elo[b]
        delta = k * ((0.5 if winner is None else float(winner == r)) - expected(red, blue))
        elo[r] += delta
        elo[b] -= delta
        yield fight, r, red, elo[r]
        yield fight, b, blue, elo[b]


def elo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.lower(F.coalesce("method", F.lit("")))
    kind = F.when(m.contains("ko") | m.contains("sub"), K_BY_CLASS["finish"]).when(m.contains("dec"), K_BY_CLASS["decision"]).otherwise(K_BY_CLASS["other"])
    rows = adapter.bouts(spark, sf_dir).select("fight_id", "ts", "red_id", "blue_id", "winner_id", kind.alias("k"))
    return folded(rows, fold_elo, "fight_id long, fighter_id long, elo_before double, elo_after double").select("fight_id", "fighter_id", F.round("elo_before", 6).alias("elo_before"), F.round("elo_after", 6).alias("elo_after"))


def elo_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's rating after its last bout."""
    h = elo_history(spark, sf_dir).join(adapter.bouts(spark, sf_dir).select("fight_id", "ts"), "fight_id")
    return h.groupBy("fighter_id").agg(F.count(F.lit(1)).alias("bouts"), F.max_by("elo_after", F.struct("ts", "fight_id")).alias("elo"))


@by_rows
def fold_points(rows):
    """Ranking Elo: K by newcomers and category of method; only bouts with a winner."""
    elo, count = defaultdict(lambda: START), defaultdict(int)
    for fight, r, b, winner, category in rows:
        before = elo[r], elo[b]
        k = (NEWCOMER_K if min(count[r], count[b]) < NEWCOMER_BOUTS else BASE_K) * CATEGORY_K[category]
        red = winner == r
        delta = k * (float(red) - expected(*before))
        elo[r] += delta
        elo[b] -= delta
        count[r] += 1
        count[b] += 1
        yield fight, r, b, red, before[0], before[1], elo[r]
        yield fight, b, r, not red, before[1], before[0], elo[b]


#: Results that don't count for the ranking, by what their method says.
NOT_RANKED = ("No Contest", "DQ", "Draw")


def ranked(bouts: DataFrame) -> DataFrame:
    """Bouts with a winner whose method counts; an unknown method does."""
    method = F.coalesce("method", F.lit(""))
    out = bouts.where("winner_id IS NOT NULL")
    for text in NOT_RANKED:
        out = out.where(~method.contains(text))
    return out


def points_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ranked(adapter.bouts(spark, sf_dir)).withColumn("division", division(F.col("weight_class"))).where("division <> 'unknown'")
    b = b.withColumn("category", method_category(F.col("method"), F.col("finish_round")))
    rows = b.select("fight_id", "ts", "red_id", "blue_id", "winner_id", "category")
    found = folded(rows, fold_points, "fight_id long, fighter_id long, opponent_id long, won boolean, elo_before double, opponent_elo_before double, elo_after double")
    return found.join(b.select("fight_id", "ts", "date", "division", "category", "weight_class"), "fight_id")


def elo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = points_history(spark, sf_dir)
    return h.groupBy("fighter_id").agg(F.count(F.lit(1)).alias("bouts"), F.round(F.max_by("elo_after", F.struct("ts", "fight_id")), 6).alias("elo"))


@by_rows
def fold_methods(rows):
    """One Elo for each class of method; only the class of the result moves, and draws move none."""
    elo = {m: defaultdict(lambda: START) for m in ("ko", "sub", "dec")}
    for fight, r, b, winner, kind in rows:
        for f in (r, b):
            yield fight, f, elo["ko"][f], elo["sub"][f], elo["dec"][f]
        pool = elo.get(kind)
        if pool is not None and winner is not None:
            delta = 32.0 * (float(winner == r) - expected(pool[r], pool[b]))
            pool[r] += delta
            pool[b] -= delta


def method_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.coalesce("method", F.lit(""))
    kind = F.when(m.contains("KO"), "ko").when(F.lower(m).contains("sub"), "sub").when(F.lower(m).contains("dec"), "dec")
    rows = adapter.bouts(spark, sf_dir).select("fight_id", "ts", "red_id", "blue_id", "winner_id", kind.alias("kind"))
    found = folded(rows, fold_methods, "fight_id long, fighter_id long, ko_elo double, sub_elo double, dec_elo double")
    return found.select("fight_id", "fighter_id", *[F.round(f"{m}_elo", 6).alias(f"{m}_elo") for m in ("ko", "sub", "dec")])


def _elo_sql(bouts: str, k: str, select: str, tables: tuple[str, ...]) -> str:
    """A keyed recursion: one row for each entity, updated bout by bout."""
    return oracle(
        select,
        *tables,
        f"o AS (SELECT *, row_number() OVER (ORDER BY ts, fight_id) AS n FROM {bouts})",
        f"""e(fighter_id, elo, bouts, n) USING KEY (fighter_id) AS (
  SELECT id, {START}::DOUBLE, 0::BIGINT, 0::BIGINT FROM (SELECT red_id AS id FROM o UNION SELECT blue_id FROM o)
  UNION SELECT CASE s WHEN 0 THEN red_id ELSE blue_id END, CASE s WHEN 0 THEN re + d ELSE be - d END, CASE s WHEN 0 THEN rn ELSE bn END + 1, n FROM (
    SELECT *, {k} * (score - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (be - re) / 400.0::DOUBLE))) AS d FROM (
      SELECT o.*, r.elo AS re, b.elo AS be, r.bouts AS rn, b.bouts AS bn, CASE WHEN o.winner_id IS NULL THEN 0.5::DOUBLE ELSE CAST(o.winner_id = o.red_id AS DOUBLE) END AS score
      FROM (SELECT max(n) + 1 AS now FROM e) t JOIN o ON o.n = t.now JOIN recurring.e r ON r.fighter_id = o.red_id JOIN recurring.e b ON b.fighter_id = o.blue_id)), (SELECT unnest([0, 1]) AS s))""",
    ).replace("WITH ev", "WITH RECURSIVE ev", 1)


_CAT = "CASE WHEN (contains(method, 'KO') OR contains(method, 'Sub')) AND finish_round <= 2 THEN 1.4::DOUBLE WHEN contains(method, 'KO') OR contains(method, 'Sub') THEN 1.2::DOUBLE WHEN contains(method, 'Split') THEN 0.75::DOUBLE WHEN contains(method, 'Majority') THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END"
ELO_POINTS_SQL = _elo_sql("w", "(CASE WHEN least(rn, bn) < 5 THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END * cat)", "SELECT fighter_id, bouts, round(elo, 6) AS elo FROM e WHERE bouts > 0", (f"w AS (SELECT *, {_CAT} AS cat FROM pr WHERE winner_id IS NOT NULL)",))


_KIND = "CASE WHEN contains(lower(coalesce(method, '')), 'ko') OR contains(lower(coalesce(method, '')), 'sub') THEN 40.0::DOUBLE WHEN contains(lower(coalesce(method, '')), 'dec') THEN 28.0::DOUBLE ELSE 32.0::DOUBLE END"
ELO_FINAL_SQL = _elo_sql("w", "kk", "SELECT fighter_id, bouts, round(elo, 6) AS elo FROM e WHERE bouts > 0", (f"w AS (SELECT *, {_KIND} AS kk FROM pr)",))


def _history_sql(name: str, bouts: str, k: str, key: str = "{0}{1}") -> tuple[str, ...]:
    """Tables that fold bouts in order with a map of (rating, bouts) as state; `name` has a row for each side.

    key: of an entity in the map, from its id and the bout's columns; k may use rc and bc, the bouts so far."""
    red, blue, red_of, blue_of = (key.format(p, c) for p in ("", "o.") for c in ("red_id", "blue_id"))
    at = lambda k, f, start: f"coalesce(f.m[{k}].{f}, {start})"
    return (
        f"{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, fight_id) AS n FROM {bouts})",
        f"""{name}_f(n, fight_id, red_id, blue_id, red_before, blue_before, d, m) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, MAP([-1::BIGINT], [{{'e': {START}::DOUBLE, 'c': 0::BIGINT}}])
  UNION ALL SELECT n, fight_id, red_id, blue_id, re, be, d, map_concat(m, MAP([{red}, {blue}], [{{'e': re + d, 'c': rc + 1}}, {{'e': be - d, 'c': bc + 1}}])) FROM (
    SELECT *, {k} * (score - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (be - re) / 400.0::DOUBLE))) AS d FROM (
      SELECT o.*, f.m, {at(red_of, "e", f"{START}::DOUBLE")} AS re, {at(blue_of, "e", f"{START}::DOUBLE")} AS be, {at(red_of, "c", "0::BIGINT")} AS rc, {at(blue_of, "c", "0::BIGINT")} AS bc, CASE WHEN o.winner_id IS NULL THEN 0.5::DOUBLE ELSE CAST(o.winner_id = o.red_id AS DOUBLE) END AS score
      FROM {name}_f f JOIN {name}_o o ON o.n = f.n + 1)))""",
        f"{name} AS (SELECT fight_id, red_id AS fighter_id, blue_id AS opponent_id, red_before AS elo_before, blue_before AS opponent_elo_before, red_before + d AS elo_after FROM {name}_f WHERE n > 0 UNION ALL SELECT fight_id, blue_id, red_id, blue_before, red_before, blue_before - d FROM {name}_f WHERE n > 0)",
    )


#: Tables up to ph: the ranking's ratings.
POINTS_TABLES = (f"pw AS (SELECT *, {_CAT} AS cat FROM pr WHERE winner_id IS NOT NULL)", *_history_sql("ph", "pw", "(CASE WHEN least(rc, bc) < 5 THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END * cat)"))
#: Tables up to eh: ratings before and after each bout, of both sides.
ELO_TABLES = (f"eh_b AS (SELECT *, {_KIND} AS kk FROM pr)", *_history_sql("eh", "eh_b", "kk"))
ELO_HISTORY_SQL = oracle("SELECT fight_id, fighter_id, round(elo_before, 6) AS elo_before, round(elo_after, 6) AS elo_after FROM eh", *ELO_TABLES).replace("WITH ev", "WITH RECURSIVE ev", 1)


def _method_sql() -> str:
    kind = "CASE WHEN contains(coalesce(method, ''), 'KO') THEN 0 WHEN contains(lower(coalesce(method, '')), 'sub') THEN 1 WHEN contains(lower(coalesce(method, '')), 'dec') THEN 2 ELSE 3 END"
    tables = [f"mb AS (SELECT *, CASE WHEN winner_id IS NULL THEN 3 ELSE {kind} END AS kind FROM pr)"]
    tables += _history_sql("mh", "mb", "CASE WHEN kind < 3 THEN 32.0::DOUBLE ELSE 0.0::DOUBLE END", "{0}{1} * 4 + {0}kind")
    # Of each class, the map as it stood before the bout.
    before = ", ".join(f"round(coalesce(p.m[x.id * 4 + {i}].e, {START}::DOUBLE), 6) AS {m}_elo" for i, m in enumerate(("ko", "sub", "dec")))
    return oracle(f"SELECT f.fight_id, x.id AS fighter_id, {before} FROM mh_f f JOIN mh_f p ON p.n = f.n - 1, (SELECT unnest([0, 1]) AS s) u, LATERAL (SELECT CASE u.s WHEN 0 THEN f.red_id ELSE f.blue_id END AS id) x WHERE f.n > 0", *tables).replace("WITH ev", "WITH RECURSIVE ev", 1)


def resume_iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume score: five passes of credit for opponents' scores (more for finishes, a share lost for
    losses), each pass one join and one aggregation over the edges between entities."""
    s = adapter.sides(spark, sf_dir)
    gain = F.when(F.col("won") == 1, F.when(F.greatest("is_ko", "is_sub") == 1, FINISH_CREDIT).otherwise(1.0)).when(F.col("lost") == 1, -LOSS_SHARE).otherwise(0.0)
    edges = s.groupBy("fighter_id", "opponent_id").agg(F.sum(gain).alias("w"), F.count(F.lit(1)).alias("n"))
    scores = s.select("fighter_id").distinct().withColumn("score", F.lit(1.0))
    for _ in range(PASSES):
        credit = edges.join(scores.withColumnRenamed("fighter_id", "opponent_id"), "opponent_id").groupBy("fighter_id").agg((1.0 + DECAY * F.sum(F.col("w") * F.col("score")) / F.sum("n")).alias("score"))
        scores = credit
    return scores.select("fighter_id", F.round("score", 8).alias("score"))


def running_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resume score before each bout as the source system runs it: all begin at 0 and every change is a
    multiple of an opponent's score, so it stays 0; resume_iterated is the one that tells something."""
    return adapter.sides(spark, sf_dir).select("fight_id", "fighter_id", F.lit(0.0).alias("resume_score"))


def _resume_sql() -> str:
    tables = ["ed AS (SELECT fighter_id, opponent_id, sum(CASE WHEN won = 1 THEN CASE WHEN greatest(is_ko, is_sub) = 1 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END WHEN lost = 1 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END) AS w, count(*) AS n FROM sides GROUP BY ALL)", "s0 AS (SELECT DISTINCT fighter_id, 1.0::DOUBLE AS score FROM sides)"]
    tables += [f"s{i + 1} AS (SELECT ed.fighter_id, 1.0::DOUBLE + 0.85::DOUBLE * sum(w * score) / sum(n) AS score FROM ed JOIN s{i} ON s{i}.fighter_id = ed.opponent_id GROUP BY ed.fighter_id)" for i in range(PASSES)]
    return oracle(f"SELECT fighter_id, round(score, 8) AS score FROM s{PASSES}", *tables)


QUERIES = {"elo_history": elo_history, "elo_final": elo_final, "elo_points": elo_points, "method_elo": method_elo, "resume_iterated": resume_iterated, "running_resume": running_resume}
ORACLES = {"elo_history": ELO_HISTORY_SQL, "method_elo": _method_sql(), "elo_final": ELO_FINAL_SQL, "elo_points": ELO_POINTS_SQL, "resume_iterated": _resume_sql(), "running_resume": oracle("SELECT fight_id, fighter_id, 0.0::DOUBLE AS resume_score FROM sides")}
