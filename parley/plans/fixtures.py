"""Stand-in tables for the queries: coded dialogue derived from the provided tables, in Spark and in SQL.

Codes come from hashes of the conversation and utterance, so both sides agree on them: the automatic code is
picked from the speaker's second tier; the gold code equals it for seven tenths of the utterances and is picked
by another hash for the rest; three raters follow the gold code likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.labels import array_of
from parley.functions.text import literal_map
from parley.operators.prepare import load_volleys, split_utterances
from parley.vocab import CLIENT_T2, COUNSELLOR_T2, T2_TO_T1

RATERS = ("a", "b", "c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_volleys(table(spark, sf_dir, "conversations"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_utterances(volleys(spark, sf_dir))


def number(salt: str, *key: str) -> Column:
    """A number below 2**32 from the md5 of salt and key."""
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def code_of(n: Column) -> Column:
    pick = lambda codes: F.get(array_of(codes), (n % len(codes)).cast("int"))
    return F.when(F.col("speaker") == "counsellor", pick(COUNSELLOR_T2)).otherwise(pick(CLIENT_T2))


def t1_of(code: Column) -> Column:
    return literal_map(T2_TO_T1)[code]


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of known speakers with t2_auto, t2_gold and their first tiers; one automatic first tier in twelve is
    unreadable, and one in eleven that of another hash, so that tiers disagree as those of models do."""
    key = ("conv_id", "conv_utt_idx")
    rows = utterances(spark, sf_dir).filter("speaker <> 'unknown'")
    rows = rows.withColumn("t2_auto", code_of(number("auto", *key)))
    rows = rows.withColumn("t2_gold", F.when(number("agree", *key) % 10 < 7, F.col("t2_auto")).otherwise(code_of(number("gold", *key))))
    own = F.when(number("odd tier", *key) % 12 == 0, "UNKNOWN").when(number("other tier", *key) % 11 == 0, t1_of(code_of(number("tier", *key))))
    return rows.withColumn("t1_auto", own.otherwise(t1_of(F.col("t2_auto")))).withColumn("t1_gold", t1_of(F.col("t2_gold")))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, conv_utt_idx, speaker, rater, label (second tier); a tenth of rater c's codes is missing."""
    key = ("conv_id", "conv_utt_idx")
    rows = coded(spark, sf_dir).select(*key, "speaker", "t2_gold")
    each = []
    for r in RATERS:
        own = F.when(number(f"sure {r}", *key) % 10 < 7, F.col("t2_gold")).otherwise(code_of(number(f"rate {r}", *key)))
        each.append(F.struct(F.lit(r).alias("rater"), (F.when(number("miss", *key) % 10 > 0, own) if r == "c" else own).alias("label")))
    return rows.select(*key, "speaker", F.inline(F.array(*each)))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, status, pre, post, week_later; a tenth of the conversations has no row."""
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().filter(number("absent", "conv_id") % 10 > 0)
    value = lambda salt: (number(salt, "conv_id") % 11).cast("double")
    status = F.when(number("status", "conv_id") % 2 == 0, "high-confidence-no-discordant").otherwise("low-confidence-or-discordant")
    return rows.select("conv_id", status.alias("status"), value("pre").alias("pre"), value("post").alias("post"), value("week").alias("week_later"))


def client_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored client utterances with their progress through the whole session."""
    from parley.operators.trajectory import with_progress, with_score

    rows = with_progress(coded_all(spark, sf_dir)).filter("speaker = 'client'")
    return with_score(rows, "t2_auto", "motiv5")


def coded_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir)


# The same in SQL, as common table expressions.
def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(values: dict) -> str:
    return "CASE {0} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else repr(v)) for k, v in values.items()) + " END"


def sql_map(values: dict, column: str) -> str:
    return _map(values).format(column)


def sql_number(salt: str, *key: str) -> str:
    return "CAST(('0x' || substr(md5(concat_ws('|', '" + salt + "', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in key) + ")), 1, 8)) AS BIGINT)"


def sql_code(n: str) -> str:
    pick = lambda codes: f"list_extract({_list(codes)}, 1 + CAST({n} % {len(codes)} AS INTEGER))"
    return f"CASE WHEN speaker = 'counsellor' THEN {pick(COUNSELLOR_T2)} ELSE {pick(CLIENT_T2)} END"


_KEY = ("conv_id", "conv_utt_idx")
CTE = {
    "volleys": """SELECT conv_id, turn AS conv_vol_idx, CASE lower(role) WHEN 'assistant' THEN 'counsellor' WHEN 'counsellor' THEN 'counsellor'
      WHEN 'counselor' THEN 'counsellor' WHEN 'therapist' THEN 'counsellor' WHEN 'user' THEN 'client' WHEN 'client' THEN 'client' ELSE 'unknown' END AS speaker,
      text AS vol_text FROM conversations""",
    "pieces": r"""SELECT conv_id, conv_vol_idx, speaker, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM
      (SELECT *, regexp_extract_all(vol_text, '[^.!?\n]+[.!?]*') AS parts FROM volleys)""",
    "utterances": r"""SELECT conv_id, speaker, conv_vol_idx, utt_text, row_number() OVER (PARTITION BY conv_id ORDER BY conv_vol_idx, pos) - 1 AS conv_utt_idx FROM
      (SELECT *, regexp_replace(part, '^\s+|\s+$', '', 'g') AS utt_text FROM pieces) WHERE utt_text <> ''""",
    "coded2": f"""SELECT *, {sql_code(sql_number("auto", *_KEY))} AS t2_auto FROM utterances WHERE speaker <> 'unknown'""",
    "coded3": f"""SELECT *, CASE WHEN {sql_number("agree", *_KEY)} % 10 < 7 THEN t2_auto ELSE {sql_code(sql_number("gold", *_KEY))} END AS t2_gold FROM coded2""",
    "coded4": f"""SELECT *, {sql_code(sql_number("tier", *_KEY))} AS t2_other FROM coded3""",
    "coded": f"""SELECT * EXCLUDE (t2_other), CASE WHEN {sql_number("odd tier", *_KEY)} % 12 = 0 THEN 'UNKNOWN' WHEN {sql_number("other tier", *_KEY)} % 11 = 0 THEN {sql_map(T2_TO_T1, "t2_other")}
      ELSE {sql_map(T2_TO_T1, "t2_auto")} END AS t1_auto, {sql_map(T2_TO_T1, "t2_gold")} AS t1_gold FROM coded4""",
    "ratings": " UNION ALL ".join(
        f"""SELECT conv_id, conv_utt_idx, speaker, '{r}' AS rater, {"CASE WHEN " + sql_number("miss", *_KEY) + " % 10 > 0 THEN " if r == "c" else ""}
      CASE WHEN {sql_number(f"sure {r}", *_KEY)} % 10 < 7 THEN t2_gold ELSE {sql_code(sql_number(f"rate {r}", *_KEY))} END {"END" if r == "c" else ""} AS label FROM coded"""
        for r in RATERS
    ),
    "outcomes": f"""SELECT conv_id, CASE WHEN {sql_number("status", "conv_id")} % 2 = 0 THEN 'high-confidence-no-discordant' ELSE 'low-confidence-or-discordant' END AS status,
      CAST({sql_number("pre", "conv_id")} % 11 AS DOUBLE) AS pre, CAST({sql_number("post", "conv_id")} % 11 AS DOUBLE) AS post,
      CAST({sql_number("week", "conv_id")} % 11 AS DOUBLE) AS week_later FROM (SELECT DISTINCT conv_id FROM conversations) WHERE {sql_number("absent", "conv_id")} % 10 > 0""",
}


def _scored() -> None:
    from parley.vocab import SCALES

    CTE["progress"] = """SELECT *, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN 100.0::DOUBLE * (row_number() OVER (PARTITION BY conv_id ORDER BY conv_utt_idx) - 1)
      / (count(*) OVER (PARTITION BY conv_id) - 1) ELSE 0.0::DOUBLE END AS progress FROM coded"""
    CTE["client_points"] = f"""SELECT *, CAST({sql_map(SCALES["motiv5"], "t2_auto")} AS DOUBLE) AS score FROM progress WHERE speaker = 'client'"""


_scored()
_NEEDS = {
    "volleys": [], "pieces": ["volleys"], "utterances": ["pieces"], "coded2": ["utterances"], "coded3": ["coded2"], "coded4": ["coded3"], "coded": ["coded4"],
    "ratings": ["coded"], "outcomes": [], "progress": ["coded"], "client_points": ["progress"],
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A query over the named stand-in tables; ``body`` may begin with further expressions as ``, name AS (...)``."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS[name]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTE[n]})" for n in order]
    body = body.strip()
    if body.startswith(","):
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + body
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def plain(text: str) -> str:
    """SQL with ``count_if(x)`` spelt as a count, whose type is BIGINT in every engine."""
    out, at = [], 0
    while (i := text.find("count_if(", at)) >= 0:
        j, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += [text[at:i], "count(CASE WHEN ", plain(text[i + len("count_if(") : j - 1]), " THEN 1 END)"]
        at = j
    return "".join([*out, text[at:]])
