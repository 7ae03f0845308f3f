"""Feature families of a side: rates, shares, flags, composites, rounds and one-hot columns.

A family is a table of (name, SQL expression) that both engines understand; Spark evaluates the
expressions as columns of one select, and oracles are built from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.operators.form import FRAMES
from duelframe.sources import adapter
from duelframe.sources.adapter import DIVISIONS, STANCES, oracle

_PER5 = {"kd": "kd", "sig_landed": "sig_landed", "sig_attempted": "sig_attempted", "total_landed": "total_landed", "td_landed": "td_landed", "td_attempted": "td_attempted", "sub_att": "sub_att", "head_landed": "head_landed", "body_landed": "body_landed", "leg_landed": "leg_landed", "distance_landed": "distance_landed", "clinch_landed": "clinch_landed", "ground_landed": "ground_landed", "ctrl": "ctrl_seconds"}


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE CAST(0 AS DOUBLE) END"


def _capped(name: str, cap: int) -> str:
    return f"least({name}, CAST({cap} AS DOUBLE)) / {cap}"


#: Counts per five minutes; a bout lasts a second at least.
RATES = {f"{name}_per5": f"CAST({c} AS DOUBLE) / greatest(fight_seconds, 1) * 300" for name, c in _PER5.items()}
SHARES = {
    "sig_acc": _share("sig_landed", "sig_attempted"), "td_acc": _share("td_landed", "td_attempted"),
    **{f"{t}_target": _share(f"{t}_attempted", "sig_attempted") for t in ("head", "body", "leg")},
    "sig_def": f"1 - {_share('opp_sig_landed', 'opp_sig_attempted')}", "td_def": f"1 - {_share('opp_td_landed', 'opp_td_attempted')}",
    **{f"opp_{c}_per5": f"CAST(opp_{_PER5[c]} AS DOUBLE) / greatest(fight_seconds, 1) * 300" for c in ("sig_landed", "td_landed", "kd", "ctrl", "sub_att")},
}
#: A method that is no decision, also an unknown one, is a finish.
FLAGS = {f"{m}_{r}": f"CASE WHEN {w} = 1 AND is_{m} = 1 THEN 1 ELSE 0 END" for r, w in (("win", "won"), ("loss", "lost")) for m in ("ko", "sub", "dec")}
FLAGS |= {"finished": "CASE WHEN won = 1 AND is_dec = 0 THEN 1 ELSE 0 END", "was_finished": "CASE WHEN lost = 1 AND is_dec = 0 THEN 1 ELSE 0 END"}
#: Weights and caps.
COMPOSITES = {
    "striking": ((0.30, _capped("kd_per5", 10)), (0.25, "sig_acc"), (0.25, _capped("sig_landed_per5", 30)), (0.20, "sig_def")),
    "grappling": ((0.30, _capped("td_landed_per5", 5)), (0.25, "td_acc"), (0.25, _capped("ctrl_per5", 300)), (0.20, _capped("sub_att_per5", 3))),
    "defense": ((0.35, "sig_def"), (0.35, "td_def"), (0.30, "(1 - was_finished)")),
    "pressure": ((0.40, _capped("total_landed_per5", 40)), (0.30, _capped("sig_attempted_per5", 30)), (0.30, _capped("td_attempted_per5", 5))),
    "finishing": ((0.40, _capped("kd_per5", 5)), (0.30, _capped("sub_att_per5", 3)), (0.30, _capped("ground_landed_per5", 10))),
}
COMPOSITES = {f"{k}_composite": " + ".join(f"CAST({w} AS DOUBLE) * {x}" for w, x in v) for k, v in COMPOSITES.items()}
BASE = {**RATES, **SHARES, **FLAGS}
KEYS = ("fight_id", "fighter_id", "corner", "ts")


def _exprs(table: dict[str, str]) -> list[Column]:
    return [F.expr(e).alias(n) for n, e in table.items()]


def _sql(table: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in table.items())


def contested(sides: DataFrame) -> DataFrame:
    """Sides of bouts that took place: a strike or an attempt was counted."""
    return sides.where("sig_landed > 0 OR sig_attempted > 0 OR td_attempted > 0")


def paired(sides: DataFrame) -> DataFrame:
    """Sides of bouts that have exactly two."""
    return sides.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("fight_id"))).where("_n = 2").drop("_n")


def bout_features(sides: DataFrame) -> DataFrame:
    """Keys, won and lost, and the families of each side, in two selects (composites need the others)."""
    more = ("won", "lost", "weight_class", "opponent_id")
    return sides.select(*KEYS, *more, *_exprs(BASE)).select("*", *_exprs(COMPOSITES))


def side_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bout_features(paired(contested(adapter.sides(spark, sf_dir))))


_BF = ("fa AS (SELECT * FROM sides WHERE sig_landed > 0 OR sig_attempted > 0 OR td_attempted > 0)", "fb AS (SELECT *, count(*) OVER (PARTITION BY fight_id) AS sides_of FROM fa)", f"f0 AS (SELECT {', '.join(KEYS)}, won, lost, weight_class, opponent_id, {_sql(BASE)} FROM fb WHERE sides_of = 2)", f"f1 AS (SELECT *, {_sql(COMPOSITES)} FROM f0)")
SIDE_SQL = oracle("SELECT * FROM f1", *_BF)

ROLLED = (*RATES, *SHARES, "won", "ko_win", "sub_win", "finished", "was_finished", *COMPOSITES)
RECENT = ("ko_win", "sub_win", "dec_win", "ko_loss", "sub_loss")
#: Sums before the bout, and rates of them.
SUMS = ("won", "lost", "finished", "was_finished", "ko_win", "sub_win", "dec_win", "ko_loss", "sub_loss", "dec_loss")
CAREER = {
    "career_fights": "career_won + career_lost",
    "career_win_pct": "CAST(career_won AS DOUBLE) / greatest(career_won + career_lost, 1)",
    "finish_rate": "CAST(career_finished AS DOUBLE) / greatest(career_won, 1)",
    "been_finished_rate": "CAST(career_was_finished AS DOUBLE) / greatest(career_lost, 1)",
    **{f"{m}_rate": f"CAST(career_{m}_win AS DOUBLE) / greatest(career_won, 1)" for m in ("ko", "sub", "dec")},
    "been_ko_rate": "CAST(career_ko_loss AS DOUBLE) / greatest(career_lost, 1)",
    "been_subbed_rate": "CAST(career_sub_loss AS DOUBLE) / greatest(career_lost, 1)",
}


def rolled(f: DataFrame, columns: tuple[str, ...] = ROLLED, sums: tuple[str, ...] = SUMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Frames and sums before each bout: one shuffle, one sort, one select."""
    by = Window.partitionBy("fighter_id").orderBy("ts", "fight_id")
    frames = [F.avg(c).over(by.rowsBetween(start, -1)).alias(f"{p}_{c}") for p, start in FRAMES.items() for c in columns]
    extra = [F.avg(c).over(by.rowsBetween(FRAMES[p], -1)).alias(f"{p}_{c}") for p in ("recent", "last3") for c in RECENT if c not in columns and sums]
    totals = [F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"career_{c}") for c in sums]
    return f.select(*KEYS, *keep, *frames, *extra, *totals)


def form_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a side before the bout: averages, recent averages, career sums and rates."""
    f = rolled(side_features(spark, sf_dir), columns=("sig_landed_per5", "td_def", "striking_composite", "won"))
    return f.select("*", *_exprs(CAREER)).drop("ts")


_FRAME = {"avg": "UNBOUNDED", "recent": "5", "last3": "3"}
_OVER = "OVER (PARTITION BY fighter_id ORDER BY ts, fight_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


def _rolled_sql(source: str, columns: tuple[str, ...], sums: tuple[str, ...] = SUMS, keep: str = "") -> str:
    cols = [f"avg({c}) {_OVER.format(n)} AS {p}_{c}" for p, n in _FRAME.items() for c in columns]
    cols += [f"avg({c}) {_OVER.format(_FRAME[p])} AS {p}_{c}" for p in ("recent", "last3") for c in RECENT if c not in columns and sums]
    cols += [f"CAST(coalesce(sum({c}) {_OVER.format('UNBOUNDED')}, 0) AS BIGINT) AS career_{c}" for c in sums]
    return f"SELECT {', '.join(KEYS)}{keep}, {', '.join(cols)} FROM {source}"


FORM_SQL = oracle(f"SELECT * EXCLUDE (ts), {_sql(CAREER)} FROM r0", *_BF, f"r0 AS ({_rolled_sql('f1', ('sig_landed_per5', 'td_def', 'striking_composite', 'won'))})")

#: Of rounds 1 to 3; a round that wasn't fought counts as 0.
ROUND_SHAPE = {
    "r1_output_share": "CAST(s1 AS DOUBLE) / greatest(s1 + s2 + s3, 1)", "late_output_share": "CAST(s2 + s3 AS DOUBLE) / greatest(s1 + s2 + s3, 1)",
    "r1_sig": "s1", "r2_sig": "s2", "r3_sig": "s3", "r1_ctrl": "c1", "r1_td": "t1",
    "output_trend": "CASE WHEN s2 + s3 > 0 THEN CAST(s2 + s3 AS DOUBLE) / 2 - s1 ELSE CAST(0 AS DOUBLE) END", "ctrl_trend": "CASE WHEN c2 + c3 > 0 THEN CAST(c2 + c3 AS DOUBLE) / 2 - c1 ELSE CAST(0 AS DOUBLE) END",
}
ROUND_ROLLED = ("r1_output_share", "late_output_share", "output_trend", "ctrl_trend", "r1_sig", "r1_ctrl", "r1_td")


def round_shapes(rounds: DataFrame) -> DataFrame:
    """By side: the first three rounds beside each other, in one conditional aggregation."""
    pick = lambda c, p: [F.coalesce(F.max(F.when(F.col("round_number") == r, F.col(c))), F.lit(0)).alias(f"{p}{r}") for r in (1, 2, 3)]
    by = rounds.groupBy(*KEYS).agg(*pick("sig_landed", "s"), *pick("ctrl_seconds", "c"), *pick("td_landed", "t"))
    return by.select(*KEYS, *_exprs(ROUND_SHAPE))


def round_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of earlier bouts' rounds: averages and recent averages before each bout."""
    x = round_shapes(adapter.rounds(spark, sf_dir))
    return rolled(x, ROUND_ROLLED, (), keep=tuple(ROUND_SHAPE)).drop("ts")


_RS = "rs AS (SELECT {0}, {1} FROM (SELECT {0}, {2} FROM rounds GROUP BY ALL))".format(", ".join(KEYS), _sql(ROUND_SHAPE), ", ".join(f"coalesce(max(CASE WHEN round_number = {r} THEN {c} END), 0) AS {p}{r}" for c, p in (("sig_landed", "s"), ("ctrl_seconds", "c"), ("td_landed", "t")) for r in (1, 2, 3)))
ROUND_FORM_SQL = oracle(f"SELECT * EXCLUDE (ts) FROM ({_rolled_sql('rs', ROUND_ROLLED, (), ', ' + ', '.join(ROUND_SHAPE))})", _RS)


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of entities parsed from texts, stance and division as columns of a fixed vocabulary."""
    f = adapter.fighters(spark, sf_dir)
    return f.select("fighter_id", text.inches(F.col("height")).alias("height_inches"), text.first_number(F.col("weight")).alias("weight_lbs"), text.first_number(F.col("reach")).alias("reach_inches"), *[F.coalesce((F.col("stance") == s).cast("double"), F.lit(0.0)).alias(f"stance_{s.lower()}") for s in STANCES], "dob")


def physical_at_bout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides with the entity's measures and age on the day (a lookup with defaults), and the division."""
    s = adapter.sides(spark, sf_dir).select("fight_id", "fighter_id", "date", "weight_class")
    x = s.join(physical(spark, sf_dir), "fighter_id", "left")
    division = text.division(F.col("weight_class"))
    vocabulary = ("flyweight", "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight", "light_heavyweight", "w_strawweight")
    return x.select("fight_id", "fighter_id", F.coalesce("height_inches", F.lit(0.0)).alias("height_inches"), "weight_lbs", F.coalesce("reach_inches", F.lit(0.0)).alias("reach_inches"), *[f"stance_{v.lower()}" for v in STANCES], text.age(F.col("date"), F.col("dob")).alias("age"), text.calendar_age(F.col("date"), F.col("dob")).alias("years"), *[(division == d).cast("double").alias(f"div_{d}") for d in vocabulary])


_DIV_SQL = ", ".join("CASE WHEN weight_class = '{}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS div_{}".format(d.replace("'", "''"), n) for d, n in zip(DIVISIONS, ("flyweight", "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight", "light_heavyweight", "w_strawweight")))
PHYSICAL_SQL = oracle(
    "SELECT fight_id, fighter_id, CASE WHEN fighter_id % 7 = 0 THEN 0 ELSE (fighter_id % 2 + 5) * 12 + fighter_id % 12 END::DOUBLE AS height_inches, (fighter_id % 9 * 10 + 125)::DOUBLE AS weight_lbs, CASE WHEN fighter_id % 5 = 0 THEN 0 ELSE fighter_id % 20 + 60 END::DOUBLE AS reach_inches, "
    + ", ".join(f"CASE WHEN fighter_id % 4 = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stance_{s.lower()}" for i, s in enumerate(STANCES))
    + f", (date - dob) / 365.25::DOUBLE AS age, CAST(date_diff('year', dob, date) - CASE WHEN (month(date), day(date)) < (month(dob), day(dob)) THEN 1 ELSE 0 END AS INTEGER) AS years, {_DIV_SQL} FROM sides JOIN fighters USING (fighter_id)"
)

STYLE_COLUMNS = ("sig_landed_per5", "sig_acc", "td_landed_per5", "td_acc", "sub_att_per5", "ctrl_per5", "kd_per5", "head_target", "body_target", "leg_target", "distance_landed_per5", "clinch_landed_per5", "ground_landed_per5")


def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the style features of each entity; 0 where there are none."""
    f = side_features(spark, sf_dir)
    return f.groupBy("fighter_id").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in STYLE_COLUMNS])


STYLE_PROFILE_SQL = oracle(f"SELECT fighter_id, {', '.join(f'coalesce(avg({c}), 0.0) AS {c}' for c in STYLE_COLUMNS)} FROM f1 GROUP BY fighter_id", *_BF)

ADJUSTED = ("sig_landed_per5", "td_landed_per5", "kd_per5", "ctrl_per5", "sub_att_per5")


def elo_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates weighed by the opponent's rating before the bout over 1500, within 0.5 and 2; opponents
    without a rating have 1500."""
    from duelframe.operators import ratings

    h = ratings.elo_history(spark, sf_dir).select("fight_id", F.col("fighter_id").alias("opponent_id"), F.col("elo_before").alias("opp_elo"))
    x = side_features(spark, sf_dir).join(h, ["fight_id", "opponent_id"], "left").withColumn("opp_elo", F.coalesce("opp_elo", F.lit(1500.0)))
    weight = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("opp_elo") / 1500.0))
    return x.select("fight_id", "fighter_id", F.round("opp_elo", 4).alias("opp_elo"), *[F.round(F.col(c) * weight, 5).alias(f"elo_adj_{c}") for c in ADJUSTED])


def _adjusted_sql() -> str:
    from duelframe.operators.ratings import ELO_TABLES

    w = "greatest(0.5::DOUBLE, least(2.0::DOUBLE, coalesce(h.elo_before, 1500.0::DOUBLE) / 1500.0::DOUBLE))"
    return oracle(f"SELECT f1.fight_id, f1.fighter_id, round(coalesce(h.elo_before, 1500.0::DOUBLE), 4) AS opp_elo, {', '.join(f'round(f1.{c} * {w}, 5) AS elo_adj_{c}' for c in ADJUSTED)} FROM f1 LEFT JOIN eh h ON h.fight_id = f1.fight_id AND h.fighter_id = f1.opponent_id", *_BF, *ELO_TABLES).replace("WITH ev", "WITH RECURSIVE ev", 1)


def by_prefix(df: DataFrame, prefixes: tuple[str, ...], always: tuple[str, ...] = ()) -> list[str]:
    """Columns that begin with one of the prefixes, then the named ones, each once and in this order."""
    return list(dict.fromkeys([*(c for c in df.columns if c.startswith(prefixes)), *(c for c in always if c in df.columns)]))


def completed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns; those it lacks are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def imputed(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Nulls of columns replaced by the column's mean (over rows where `train` holds), else by 0. One row of
    means, broadcast."""
    means = df.agg(*[F.avg(F.when(train, F.col(c)) if train is not None else F.col(c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    at = {c: i for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(means)).select(*[F.coalesce(F.col(c), F.col(f"_m{at[c]}"), F.lit(0.0)).alias(c) if c in at else F.col(c) for c in df.columns])


def imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with gaps filled by the mean of all, and by that of the entities with an even id; one
    expected column is missing."""
    p = physical(spark, sf_dir)
    every = imputed(p, ["height_inches", "reach_inches"]).select("fighter_id", F.col("height_inches").alias("height_all"), F.col("reach_inches").alias("reach_all"))
    train = imputed(p, ["height_inches", "reach_inches"], F.col("fighter_id") % 2 == 0).withColumnsRenamed({"height_inches": "height_train", "reach_inches": "reach_train"})
    columns = by_prefix(every.join(train, "fighter_id"), ("height_", "reach_"), ("fighter_id", "height_all"))
    return completed(every.join(train, "fighter_id"), [*columns, "not_measured"])


IMPUTATION_SQL = oracle(
    "SELECT fighter_id, coalesce(h, (SELECT avg(h) FROM p)) AS height_all, coalesce(r, (SELECT avg(r) FROM p)) AS reach_all, coalesce(h, (SELECT avg(h) FROM p WHERE fighter_id % 2 = 0)) AS height_train, coalesce(r, (SELECT avg(r) FROM p WHERE fighter_id % 2 = 0)) AS reach_train, 0.0::DOUBLE AS not_measured FROM p",
    "p AS (SELECT fighter_id, CASE WHEN fighter_id % 7 <> 0 THEN (fighter_id % 2 + 5) * 12 + fighter_id % 12 END::DOUBLE AS h, CASE WHEN fighter_id % 5 <> 0 THEN fighter_id % 20 + 60 END::DOUBLE AS r FROM fighters)",
)

QUERIES = {"side_features": side_features, "form_features": form_features, "round_form": round_form, "physical_at_bout": physical_at_bout, "style_profile": style_profile, "elo_adjusted": elo_adjusted, "imputation": imputation}
ORACLES = {"side_features": SIDE_SQL, "form_features": FORM_SQL, "round_form": ROUND_FORM_SQL, "physical_at_bout": PHYSICAL_SQL, "style_profile": STYLE_PROFILE_SQL, "elo_adjusted": _adjusted_sql(), "imputation": IMPUTATION_SQL}
