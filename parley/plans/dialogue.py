"""Queries: preparation, context, prompts, label reading, filters, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import labels as L
from parley.functions.text import model_slug, normal_speaker, strip
from parley.operators import context, prepare, prompts, splits, templates
from parley.plans import fixtures as fx
from parley.operators.order import percentiles, running_index
from parley.operators.rollup import crosswalk as as_crosswalk
from parley.sources.readers import normal_form as as_normal_form
from parley.sources.readers import read_rows
from parley.vocab import ALIASES, CLIENT_T1, CLIENT_T2, COUNSELLOR_T1, COUNSELLOR_T2, SPEAKERS, T1_GROUPS, THIRD_PARTY_T1, THIRD_PARTY_T2, vocabulary

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = fx.plain(sql)
        return f

    return add


def _codes(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(fx.sql("SELECT conv_id, conv_vol_idx, speaker, length(vol_text) AS n_chars FROM volleys", "volleys"))
def load_volleys(spark, sf):
    return fx.volleys(spark, sf).select("conv_id", "conv_vol_idx", "speaker", F.length("vol_text").cast("long").alias("n_chars"))


@query(
    "SELECT conv_id, turn, coalesce(" + fx.sql_map(SPEAKERS, r"lower(regexp_replace(name, '^\s+|\s+$', '', 'g'))") + r", lower(regexp_replace(name, '^\s+|\s+$', '', 'g'))) AS speaker FROM "
    "(SELECT *, CASE role WHEN 'assistant' THEN ' Therapist' WHEN 'user' THEN 'PATIENT' ELSE role END AS name FROM conversations)"
)
def speaker_norm(spark, sf):
    name = F.when(F.col("role") == "assistant", " Therapist").when(F.col("role") == "user", "PATIENT").otherwise(F.col("role"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", normal_speaker(name).alias("speaker"))


@query(fx.sql("SELECT v.conv_id, v.conv_vol_idx, v.speaker FROM volleys v SEMI JOIN (SELECT * FROM outcomes WHERE status LIKE 'high%') o ON v.conv_id = o.conv_id", "volleys", "outcomes"))
def subset_semi_join(spark, sf):
    return prepare.with_status(fx.volleys(spark, sf), fx.outcomes(spark, sf), "high-confidence-no-discordant").select("conv_id", "conv_vol_idx", "speaker")


@query(
    fx.sql(
        "SELECT v.conv_id, v.conv_vol_idx FROM volleys v JOIN (SELECT conv_id FROM volleys GROUP BY conv_id ORDER BY min(length(vol_text)), conv_id LIMIT 7) f ON v.conv_id = f.conv_id",
        "volleys",
    )
)
def first_n_convs(spark, sf):
    rows = fx.volleys(spark, sf).withColumn("order_key", F.length("vol_text"))
    return prepare.first_conversations(rows, 7, ["order_key"]).select("conv_id", "conv_vol_idx")


@query(fx.sql("SELECT conv_id, conv_vol_idx FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS r FROM volleys) WHERE r <= 5", "volleys"))
def limit_sorted_convs(spark, sf):
    return prepare.first_conversations(fx.volleys(spark, sf), 5, []).select("conv_id", "conv_vol_idx")


@query(fx.sql("SELECT conv_id, conv_vol_idx, conv_utt_idx, speaker, utt_text FROM utterances", "utterances"))
def segment_utterances(spark, sf):
    return fx.utterances(spark, sf).select("conv_id", "conv_vol_idx", "conv_utt_idx", "speaker", "utt_text")


@query(
    fx.sql(
        """SELECT conv_id, conv_vol_idx, conv_utt_idx, row_number() OVER (ORDER BY conv_id, conv_utt_idx) - 1 AS corp_utt_idx,
        dense_rank() OVER (ORDER BY conv_id, conv_vol_idx) - 1 AS corp_vol_idx, dense_rank() OVER (ORDER BY conv_id) - 1 AS corp_conv_idx FROM utterances""",
        "utterances",
    )
)
def index_assignment(spark, sf):
    return prepare.index_utterances(fx.utterances(spark, sf)).select("conv_id", "conv_vol_idx", "conv_utt_idx", "corp_utt_idx", "corp_vol_idx", "corp_conv_idx")


@query(fx.sql("SELECT avg(n)::DOUBLE AS avg_volleys FROM (SELECT count(*) AS n FROM volleys GROUP BY conv_id)", "volleys"))
def average_length(spark, sf):
    return prepare.average_conversation_length(fx.volleys(spark, sf))


def _context_body(source: str, condition: str) -> str:
    """conv_id, conv_utt_idx and the context of every utterance of a table."""
    return f"""SELECT conv_id, conv_utt_idx, string_agg(speaker || ': ' || texts, chr(10) ORDER BY run) AS context FROM (
          SELECT conv_id, conv_utt_idx, run, min(speaker) AS speaker, string_agg(utt_text, ' ' ORDER BY i) AS texts FROM (
            SELECT *, sum(new) OVER (PARTITION BY conv_id, conv_utt_idx ORDER BY i) AS run FROM (
              SELECT t.conv_id, t.conv_utt_idx, c.conv_utt_idx AS i, c.speaker, c.utt_text,
                CASE WHEN c.speaker = lag(c.speaker) OVER (PARTITION BY t.conv_id, t.conv_utt_idx ORDER BY c.conv_utt_idx) THEN 0 ELSE 1 END AS new
              FROM {source} t JOIN {source} c ON t.conv_id = c.conv_id AND {condition}))
          GROUP BY conv_id, conv_utt_idx, run) GROUP BY conv_id, conv_utt_idx"""


def _context_sql(condition: str) -> str:
    return fx.sql(f"SELECT conv_id, conv_utt_idx, md5(context) AS context_md5 FROM ({_context_body('utterances', condition)})", "utterances")


_INTERVAL = "c.conv_vol_idx >= t.conv_vol_idx - 3 AND c.conv_utt_idx <= t.conv_utt_idx"


def _context(mode: str):
    def run(spark, sf):
        return context.with_context(fx.utterances(spark, sf), mode, 3).select("conv_id", "conv_utt_idx", F.md5("context").alias("context_md5"))

    return run


for _mode, _cond in (
    ("interval", _INTERVAL),
    ("cumulative", "c.conv_utt_idx <= t.conv_utt_idx"),
    ("all", "true"),
):
    QUERIES[f"context_{_mode}"], SQL[f"context_{_mode}"] = _context(_mode), _context_sql(_cond)

_BARE = (
    "'Codes: ' || CASE speaker WHEN 'counsellor' THEN '" + ", ".join(COUNSELLOR_T2) + "' ELSE '" + ", ".join(CLIENT_T2) + "' END || chr(10) || 'Speaker: ' || speaker || chr(10) || "
    "'Utterance: ' || utt_text || chr(10) || 'Code:'"
)


@query(fx.sql(f"SELECT conv_id, conv_utt_idx, md5({_BARE}) AS prompt_md5, ' ' || t2_gold || chr(10) AS completion FROM coded", "coded"))
def prompts_bare(spark, sf):
    rows = fx.coded(spark, sf)
    text = prompts.bare_prompt(F.col("speaker"), F.col("utt_text"), "t2")
    return rows.select("conv_id", "conv_utt_idx", F.md5(text).alias("prompt_md5"), prompts.completion(F.col("t2_gold")).alias("completion"))


@query(
    fx.sql(
        "SELECT conv_id, conv_utt_idx, md5(CASE speaker WHEN 'counsellor' THEN '" + prompts.INSTRUCTIONS["counsellor"] + "' ELSE '" + prompts.INSTRUCTIONS["client"]
        + f"' END || chr(10) || '{prompts.CODE_ONLY}' || chr(10) || {_BARE}) AS prompt_md5 FROM coded",
        "coded",
    )
)
def prompts_rich(spark, sf):
    return fx.coded(spark, sf).select("conv_id", "conv_utt_idx", F.md5(prompts.rich_prompt(F.col("speaker"), F.col("utt_text"), "t2")).alias("prompt_md5"))


@query(fx.sql("SELECT conv_id, conv_utt_idx, 'Speaker: ' || speaker || chr(10) || 'Utterance: ' || utt_text || chr(10) || 'Label:' AS prompt FROM coded", "coded"))
def prompts_plain(spark, sf):
    return fx.coded(spark, sf).select("conv_id", "conv_utt_idx", prompts.plain_prompt(F.col("speaker"), F.col("utt_text")).alias("prompt"))


def _with_context(spark, sf):
    return context.with_context(fx.coded(spark, sf), "interval", 3)


_IN_CONTEXT = f", ctx AS ({_context_body('coded', _INTERVAL)}), rows AS (SELECT coded.*, ctx.context FROM coded JOIN ctx USING (conv_id, conv_utt_idx)) "
_USER = "'Conversation:' || chr(10) || context || chr(10) || chr(10) || 'Code this: ' || speaker || ': ' || utt_text"
_LEAD = "CASE speaker WHEN 'counsellor' THEN '" + prompts.INSTRUCTIONS["counsellor"] + "' ELSE '" + prompts.INSTRUCTIONS["client"] + "' END"
_OPEN = "'<system>' || chr(10) || "
_CLOSE = " || chr(10) || '<user>' || chr(10) || " + _USER + " || chr(10)"


@query(
    fx.sql(
        f"{_IN_CONTEXT}SELECT conv_id, conv_utt_idx, md5({_OPEN}{_LEAD} || ' Codes: ' || CASE speaker WHEN 'counsellor' THEN '{', '.join(COUNSELLOR_T1)}' ELSE '{', '.join(CLIENT_T1)}' END{_CLOSE}) AS chat_md5 FROM rows",
        "coded",
    )
)
def chat_messages_t1(spark, sf):
    return prompts.messages_t1(_with_context(spark, sf)).select("conv_id", "conv_utt_idx", F.md5(prompts.render(F.col("messages"))).alias("chat_md5"))


@query(
    fx.sql(
        f"{_IN_CONTEXT}SELECT conv_id, conv_utt_idx, md5({_OPEN}{_LEAD} || ' Group: ' || {fx.sql_map(prompts.SPECS, 't1_gold')} || ' Codes: ' || "
        + fx.sql_map({k: ", ".join(v) for k, v in T1_GROUPS.items()}, "t1_gold")
        + f"{_CLOSE}) AS chat_md5 FROM rows",
        "coded",
    )
)
def chat_messages_t2(spark, sf):
    return prompts.messages_t2(_with_context(spark, sf), "t1_gold").select("conv_id", "conv_utt_idx", F.md5(prompts.render(F.col("messages"))).alias("chat_md5"))


@query(fx.sql("SELECT conv_id, conv_utt_idx, CAST(json_object('prompt', 'Utterance: ' || utt_text, 'completion', ' ' || t2_gold || chr(10)) AS VARCHAR) AS line FROM coded", "coded"))
def completion_jsonl(spark, sf):
    record = F.struct(F.concat(F.lit("Utterance: "), "utt_text").alias("prompt"), prompts.completion(F.col("t2_gold")).alias("completion"))
    return fx.coded(spark, sf).select("conv_id", "conv_utt_idx", F.to_json(record).alias("line"))


@query(
    fx.sql(
        f""", w AS (SELECT conv_id, conv_utt_idx, unnest(string_split(utt_text, ' ')) AS word, generate_subscripts(string_split(utt_text, ' '), 1) AS pos FROM coded),
        v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + {len(vocabulary("t2"))} AS id FROM w GROUP BY word),
        e AS (SELECT conv_id, conv_utt_idx, list(id ORDER BY pos) AS p FROM w JOIN v USING (word) GROUP BY ALL),
        b AS (SELECT conv_id, conv_utt_idx, p, list_position({_codes(vocabulary("t2"))}, t2_gold) AS c FROM e JOIN coded USING (conv_id, conv_utt_idx))
        SELECT conv_id, conv_utt_idx, array_to_string(list_slice(list_concat(p, [c, 0]), 1, 12), ',') AS input_ids,
          array_to_string(list_slice(list_concat(list_transform(p, lambda x: -100), [c, 0]), 1, 12), ',') AS labels FROM b""",
        "coded",
    )
)
def masked_examples(spark, sf):
    """Training examples in the ids of the corpus's own words, codes first, with the prompt masked."""
    rows, codes = fx.coded(spark, sf).select("conv_id", "conv_utt_idx", "utt_text", "t2_gold"), vocabulary("t2")
    known = prompts.with_word_ids(rows, ["conv_id", "conv_utt_idx"], "utt_text", prompts.word_vocabulary(rows, "utt_text", len(codes) + 1))
    both = prompts.mask_prompt(F.col("ids"), F.array(F.array_position(L.array_of(codes), F.col("t2_gold")).cast("int")), 0, 12)
    join = lambda c: F.array_join(both[c].cast("array<string>"), ",").alias(c)
    return known.select("conv_id", "conv_utt_idx", join("input_ids"), join("labels"))


# Label reading: raw answers made from codes in several shapes.
_SHAPES = [
    lambda c: F.concat(F.lit("**"), c, F.lit("**. because of the tone")),
    lambda c: F.concat(F.lit("The best fit, I think, is `"), c, F.lit("`.")),
    lambda c: F.concat(F.lit('{"explanation": "GI or SR?", "label": "'), c, F.lit('"}')),
    lambda c: F.lit("no idea"),
    lambda c: F.lit("ADWP"),
]
_SQL_SHAPES = [
    "'**' || t2_auto || '**. because of the tone'", "'The best fit, I think, is `' || t2_auto || '`.'",
    "'{\"explanation\": \"GI or SR?\", \"label\": \"' || t2_auto || '\"}'", "'no idea'", "'ADWP'",
]
_ANSWERS = (
    ", answers AS (SELECT *, CASE " + " ".join(f"WHEN {fx.sql_number('shape', 'conv_id', 'conv_utt_idx')} % 5 = {i} THEN {s}" for i, s in enumerate(_SQL_SHAPES))
    + f" END AS answer, CASE speaker WHEN 'counsellor' THEN {_codes(COUNSELLOR_T2)} ELSE {_codes(CLIENT_T2)} END AS allowed FROM coded)"
)


def _answers(spark, sf):
    n = fx.number("shape", "conv_id", "conv_utt_idx") % len(_SHAPES)
    answer = F.when(n == 0, _SHAPES[0](F.col("t2_auto")))
    for i, shape in enumerate(_SHAPES[1:], 1):
        answer = answer.when(n == i, shape(F.col("t2_auto")))
    return fx.coded(spark, sf).withColumn("answer", answer).withColumn("allowed", L.allowed_codes(F.col("speaker"), "t2"))


def _clean(token: str, marks: str, trailing: bool) -> str:
    out = rf"regexp_replace(regexp_replace({token}, '^[{marks}]+|[{marks}]+$', '', 'g'), '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace({out}, '[.,;:]+$', '')" if trailing else out


_ALIAS = fx.sql_map(ALIASES, "{0}")


def _resolved(token: str) -> str:
    alias = _ALIAS.format(token)
    return f"CASE WHEN list_contains(allowed, {token}) THEN {token} WHEN list_contains(allowed, {alias}) THEN {alias} END"


_MARKS = r"`*_:()\[\]" + "\"'' \\t"


def _parse_sql(kind: str) -> str:
    marks = {"head": _MARKS, "field": r"`*_:()\[\]{}" + "\"'' \\t", "lenient": r"`*_:()\[\]"}[kind]
    trailing = kind != "lenient"
    read = lambda expr: f"list_filter(list_transform(list_transform({expr}, lambda x: {_clean('x', marks, trailing)}), lambda t: {_resolved('t')}), lambda r: r IS NOT NULL)"
    words = r"regexp_split_to_array(answer, '\s+')[1:1]"
    tokens = r"regexp_split_to_array(answer, '[\s,;.\n]+')"
    kept = f"list_filter({tokens}, lambda x: x <> '')"
    fields = "list_reverse(regexp_extract_all(answer, '" + L.FIELD.replace("'", "''") + "', 1))"
    if kind == "head":
        candidates = f"list_concat({read(words)}, {read(tokens)})"
    elif kind == "field":
        candidates = f"list_concat(list_concat({read(fields)}, {read(f'{kept}[1:1]')}), list_reverse({read(kept)}))"
    else:
        candidates = read(tokens)
    return fx.sql(f"{_ANSWERS} SELECT conv_id, conv_utt_idx, coalesce(({candidates})[1], 'UNKNOWN') AS code FROM answers", "coded")


def _parse(f):
    return lambda spark, sf: _answers(spark, sf).select("conv_id", "conv_utt_idx", f(F.col("answer"), F.col("allowed")).alias("code"))


for _kind, _f in (("head", L.parse_head), ("field", L.parse_field), ("lenient", L.parse_lenient)):
    QUERIES[f"label_parse_{_kind}"], SQL[f"label_parse_{_kind}"] = _parse(_f), _parse_sql(_kind)


@query(
    fx.sql(
        f"""SELECT speaker, count(*) AS n, count_if(list_contains(CASE speaker WHEN 'counsellor' THEN {_codes(COUNSELLOR_T2)} ELSE {_codes(CLIENT_T2)} END, code)) AS n_valid
        FROM (SELECT speaker, CASE WHEN conv_utt_idx % 4 = 0 THEN t2_auto || ' ' WHEN conv_utt_idx % 4 = 1 THEN 'XX' ELSE t2_auto END AS raw, trim(raw) AS code FROM coded) GROUP BY speaker""",
        "coded",
    )
)
def valid_labels(spark, sf):
    i = F.col("conv_utt_idx") % 4
    rows = fx.coded(spark, sf).withColumn("raw", F.when(i == 0, F.concat("t2_auto", F.lit(" "))).when(i == 1, "XX").otherwise(F.col("t2_auto")))
    return rows.groupBy("speaker").agg(F.count("*").alias("n"), F.count_if(L.is_valid(F.col("raw"), F.col("speaker"), "t2")).alias("n_valid"))


@query(fx.sql("SELECT conv_id, conv_utt_idx, t2_gold FROM coded WHERE conv_utt_idx % 5 <> 0 AND length(utt_text) > 0", "coded"))
def labelled_rows(spark, sf):
    rows = fx.coded(spark, sf).withColumn("label", F.when(F.col("conv_utt_idx") % 5 != 0, F.col("t2_gold")))
    return prepare.labelled(rows, "label", "t2").select("conv_id", "conv_utt_idx", "t2_gold")


@query(fx.sql("SELECT speaker, count(*) AS n_unknown FROM utterances WHERE speaker = 'unknown' GROUP BY speaker", "utterances"))
def unknown_speakers(spark, sf):
    return fx.utterances(spark, sf).filter("speaker = 'unknown'").groupBy("speaker").agg(F.count("*").alias("n_unknown"))


@query(
    fx.sql(
        "SELECT conv_id, conv_utt_idx, CASE WHEN n > 0 THEN array_to_string(g, ',') ELSE array_to_string(f, ',') END AS codes FROM (SELECT *, "
        + "CASE WHEN conv_utt_idx % 3 = 0 THEN 'UNKNOWN' ELSE t1_auto END AS given, "
        + "CASE given " + " ".join(f"WHEN '{k}' THEN {_codes(v)}" for k, v in T1_GROUPS.items()) + f" ELSE []::VARCHAR[] END AS g, len(g) AS n, CASE speaker WHEN 'counsellor' THEN {_codes(COUNSELLOR_T2)} ELSE {_codes(CLIENT_T2)} END AS f FROM coded)",
        "coded",
    )
)
def allowed_t2(spark, sf):
    given = F.when(F.col("conv_utt_idx") % 3 == 0, "UNKNOWN").otherwise(F.col("t1_auto"))
    return fx.coded(spark, sf).select("conv_id", "conv_utt_idx", F.array_join(L.allowed_in_group(F.col("speaker"), given), ",").alias("codes"))


def _datasets(spark, sf):
    return fx.coded(spark, sf).withColumn("dataset", F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")))


_LODO = "SELECT *, 'd' || CAST(conv_id % 3 AS VARCHAR) AS dataset FROM coded"


@query(fx.sql(f"SELECT dataset, conv_id, conv_utt_idx, CASE WHEN dataset = 'd2' THEN 'test' ELSE 'train' END AS split, ' ' || t2_gold || chr(10) AS completion FROM ({_LODO})", "coded"))
def examples_lodo(spark, sf):
    out = splits.leave_dataset_out(prepare.labelled(_datasets(spark, sf), "t2_gold", "t2"), ["d0", "d1"], "d2")
    return out.select("dataset", "conv_id", "conv_utt_idx", "split", prompts.completion(F.col("t2_gold")).alias("completion"))


@query(fx.sql(f"SELECT CASE WHEN dataset = 'd2' THEN 'test' ELSE 'train' END AS split, dataset, count(*) AS n FROM ({_LODO}) GROUP BY ALL", "coded"))
def lodo_summary(spark, sf):
    return splits.split_summary(splits.leave_dataset_out(_datasets(spark, sf), ["d0", "d1"], "d2"))


_THEIRS = ["CR", "SR", "CQ", "OQ", "GI", "ADVI", "NEGO", "OPTI", "O", "C", "S", "N", "XX"]
_THEIR_CODE = f"list_extract({_codes(_THEIRS)}, 1 + CAST((5 * turn + conv_id) % {len(_THEIRS)} AS INTEGER))"
_THEIR_TIERS = (
    f"CASE WHEN speaker = 'counsellor' THEN {fx.sql_map(THIRD_PARTY_T1, 'code')} WHEN code IN ('C', 'S', 'N') THEN code END AS t1_label, "
    f"CASE WHEN speaker = 'counsellor' THEN {fx.sql_map(THIRD_PARTY_T2, 'code')} END AS t2_label"
)


def _third_party(spark, sf):
    """Turns with a third party's label: a bare code, or a list literal that begins with it."""
    code = F.get(L.array_of(_THEIRS), ((5 * F.col("turn") + F.col("conv_id")) % len(_THEIRS)).cast("int"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("['"), code, F.lit("', 'SR']"))).otherwise(code)
    return fx.table(spark, sf, "conversations").withColumn("raw", raw)


@query(f"SELECT conv_id, turn, speaker, {_THEIR_TIERS} FROM (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'counsellor' ELSE 'client' END AS speaker, {_THEIR_CODE} AS code FROM conversations)")
def crosswalk_t1_t2(spark, sf):
    first, who = L.first_label(F.col("raw")), F.col("speaker")
    rows = _third_party(spark, sf).withColumn("speaker", F.when(F.col("role") == "assistant", "counsellor").otherwise("client"))
    return rows.select("conv_id", "turn", "speaker", L.third_party_t1(first, who).alias("t1_label"), L.third_party_t2(first, who).alias("t2_label"))


@query(
    f"SELECT conv_id, turn, speaker, {_THEIR_TIERS} FROM (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'counsellor' WHEN 'user' THEN 'client' ELSE role END AS speaker, {_THEIR_CODE} AS code FROM conversations)"
)
def crosswalk_by_speaker(spark, sf):
    """The loader's crosswalk on speakers' synonyms: the counsellor's codes by table, of others the client codes alone."""
    name = F.when(F.col("role") == "assistant", " Therapist ").when(F.col("role") == "user", "Patient").otherwise(F.col("role"))
    return as_crosswalk(_third_party(spark, sf).withColumn("speaker", name), "raw").select("conv_id", "turn", "speaker", "t1_label", "t2_label")


class _Lines:
    """A segmenter that takes every line as an utterance."""

    def split(self, texts: list[str]) -> list[list[str]]:
        return [t.split("\n") for t in texts]


@query(
    fx.sql(
        r"""SELECT conv_id, conv_vol_idx, row_number() OVER (PARTITION BY conv_id ORDER BY conv_vol_idx, pos) - 1 AS conv_utt_idx, md5(part) AS utt_md5 FROM
        (SELECT conv_id, conv_vol_idx, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT *, string_split(vol_text, chr(10)) AS parts FROM volleys))
        WHERE regexp_replace(part, '^\s+|\s+$', '', 'g') <> ''""",
        "volleys",
    )
)
def segment_by_provider(spark, sf):
    return prepare.split_utterances(fx.volleys(spark, sf), _Lines).select("conv_id", "conv_vol_idx", "conv_utt_idx", F.md5("utt_text").alias("utt_md5"))


@query()
def masked_tokens(spark, sf):
    """Prompt and completion in the ids of a public tokenizer, cut, masked and padded."""
    import public_tokenizers

    rows = fx.coded(spark, sf).select("conv_id", "conv_utt_idx", prompts.bare_prompt(F.col("speaker"), F.col("utt_text"), "t2").alias("prompt"), prompts.completion(F.col("t2_gold")).alias("completion"))
    return prompts.tokenised(rows, public_tokenizers.path("byte_bpe_50k.json"), 50256, 256).drop("prompt", "completion")


_TEMPLATE = """{% if before -%}
Before: {{ before }}
{% endif -%}
{{ speaker | upper }}: {{ utt_text }}
{%- if speaker == 'client' and t1_gold %} ({{ t1_gold | lower }}){% elif not t1_gold %} (?){% endif %}
Codes:{% for c in codes %}
{{ loop.index }}. {{ c }}{% if not loop.last %};{% endif %}{% endfor %}
"""


def _numbered(codes) -> str:
    return "'" + "".join(f"\n{i + 1}. {c}" + (";" if i + 1 < len(codes) else "") for i, c in enumerate(codes)) + "'"


@query(
    fx.sql(
        f""", b AS (SELECT *, lag(utt_text) OVER (PARTITION BY conv_id ORDER BY conv_utt_idx) AS before FROM coded)
        SELECT conv_id, conv_utt_idx, md5(CASE WHEN before IS NULL THEN '' ELSE 'Before: ' || before || chr(10) END || upper(speaker) || ': ' || utt_text
          || CASE WHEN speaker = 'client' AND t1_gold IS NOT NULL THEN ' (' || lower(t1_gold) || ')' WHEN t1_gold IS NULL THEN ' (?)' ELSE '' END || chr(10) || 'Codes:'
          || CASE speaker WHEN 'client' THEN {_numbered(CLIENT_T1)} ELSE {_numbered(COUNSELLOR_T1)} END) AS prompt_md5 FROM b""",
        "coded",
    )
)
def templated_prompts(spark, sf):
    """A template with fields, conditions and a loop over the speaker's codes, as one column expression."""
    from pyspark.sql import Window

    rows = fx.coded(spark, sf).withColumn("before", F.lag("utt_text").over(Window.partitionBy("conv_id").orderBy("conv_utt_idx")))
    codes = F.when(F.col("speaker") == "client", L.array_of(CLIENT_T1)).otherwise(L.array_of(COUNSELLOR_T1))
    return rows.select("conv_id", "conv_utt_idx", F.md5(templates.compiled(_TEMPLATE, rows, {"codes": codes})).alias("prompt_md5"))


_MIXED = "md5('{0}|' || CAST({1} AS VARCHAR))"


@query(
    "SELECT conv_id, (row_number() OVER (ORDER BY " + _MIXED.format(42, "conv_id") + ", conv_id) - 1) % 5 AS fold FROM (SELECT DISTINCT conv_id FROM conversations)"
)
def folds(spark, sf):
    return splits.conversation_folds(fx.table(spark, sf, "conversations"), 5)


@query(
    "SELECT fold, count(*) AS n FROM (SELECT conv_id, (row_number() OVER (ORDER BY " + _MIXED.format(42, "conv_id") + ", conv_id) - 1) % 5 AS fold FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY fold"
)
def fold_counts(spark, sf):
    return splits.conversation_folds(fx.table(spark, sf, "conversations"), 5).groupBy("fold").agg(F.count("*").alias("n"))


@query(
    fx.sql(
        "SELECT part, count(*) AS n, count(DISTINCT c.conv_id) AS n_convs FROM (SELECT c.conv_id, CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS part FROM coded c JOIN (SELECT conv_id, (row_number() OVER (ORDER BY "
        + _MIXED.format(42, "conv_id") + ", conv_id) - 1) % 5 AS fold FROM (SELECT DISTINCT conv_id FROM conversations)) f ON c.conv_id = f.conv_id) c GROUP BY part",
        "coded",
    )
)
def fold_rows(spark, sf):
    rows = splits.fold_rows(fx.coded(spark, sf), splits.conversation_folds(fx.table(spark, sf, "conversations"), 5), 2)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


_UKEY = "concat_ws('|', CAST(conv_id AS VARCHAR), CAST(conv_utt_idx AS VARCHAR))"


@query(
    fx.sql(
        "SELECT conv_id, conv_utt_idx, CASE WHEN row_number() OVER (ORDER BY " + _MIXED.format(42, _UKEY) + ", conv_id, conv_utt_idx) <= CAST(floor((SELECT count(*) FROM coded) * 0.1) AS BIGINT) THEN 'valid' ELSE 'train' END AS part FROM coded",
        "coded",
    )
)
def train_valid_split(spark, sf):
    return splits.train_valid(fx.coded(spark, sf), ["conv_id", "conv_utt_idx"], 0.1).select("conv_id", "conv_utt_idx", "part")


@query(fx.sql("SELECT conv_id, conv_utt_idx FROM coded ORDER BY " + _MIXED.format(42, _UKEY) + ", conv_id, conv_utt_idx LIMIT 100", "coded"))
def sample_n(spark, sf):
    return splits.sample_n(fx.coded(spark, sf).select("conv_id", "conv_utt_idx"), ["conv_id", "conv_utt_idx"], 100)


@query(fx.sql("SELECT conv_id, conv_utt_idx FROM coded WHERE conv_utt_idx % 3 <> 0 OR conv_id % 2 = 0", "coded"))
def resume_anti_join(spark, sf):
    rows = fx.coded(spark, sf).select("conv_id", "conv_utt_idx")
    return prepare.not_yet_done(rows, rows.filter("conv_utt_idx % 3 = 0 AND conv_id % 2 = 1"), ["conv_id", "conv_utt_idx"])


@query(fx.sql("SELECT max(conv_utt_idx) AS high_water_mark FROM coded", "coded"))
def high_water_mark(spark, sf):
    return prepare.high_water_mark(fx.coded(spark, sf), "conv_utt_idx")


@query(
    fx.sql(
        """SELECT a.place, a.conv_id, a.conv_vol_idx, b.doc_id FROM (SELECT *, row_number() OVER (ORDER BY conv_id, conv_vol_idx) - 1 AS place FROM volleys) a
        JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM labels) b ON a.place = b.place""",
        "volleys",
    )
)
def positional_zip(spark, sf):
    left, right = fx.volleys(spark, sf).select("conv_id", "conv_vol_idx"), fx.table(spark, sf, "labels").select("doc_id")
    return prepare.positional_zip(left, right, ["conv_id", "conv_vol_idx"], ["doc_id"])


@query(fx.sql("SELECT quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.95)::DOUBLE AS p95, max(n)::BIGINT AS longest, count_if(n > 200) AS too_long FROM (SELECT length(" + _BARE + ") AS n FROM coded)", "coded"))
def prompt_lengths(spark, sf):
    n = fx.coded(spark, sf).select(F.length(prompts.bare_prompt(F.col("speaker"), F.col("utt_text"), "t2")).alias("n"))
    sums = n.agg(F.max("n").cast("long").alias("longest"), F.count_if(F.col("n") > 200).alias("too_long"))
    return percentiles(n, ["n"], {"median": 0.5, "p95": 0.95}).drop("metric").crossJoin(sums)  # one row each


@query()
def prompt_token_lengths(spark, sf):
    """Training examples (prompt and completion) in tokens of a public tokenizer against a limit."""
    import public_tokenizers

    text = F.concat(prompts.bare_prompt(F.col("speaker"), F.col("utt_text"), "t2"), prompts.completion(F.col("t2_gold")))
    rows = prompts.with_token_count(fx.coded(spark, sf).select(text.alias("example")), "example", public_tokenizers.path("byte_bpe_50k.json"))
    return prompts.length_report(rows, "n_tokens", 128)


@query(fx.sql("SELECT conv_id, conv_utt_idx, speaker FROM coded WHERE speaker = 'client' AND (t1_gold IS NULL OR conv_utt_idx % 6 = 0)", "coded"))
def missing_probe(spark, sf):
    rows = fx.coded(spark, sf).withColumn("other", F.when(F.col("conv_utt_idx") % 6 != 0, F.col("t2_auto")))
    return rows.filter((F.col("speaker") == "client") & (F.col("t1_gold").isNull() | F.col("other").isNull())).select("conv_id", "conv_utt_idx", "speaker")


@query("SELECT conv_id, turn, split_part('org/' || role, '/', -1) AS slug, upper(trim('  ' || role || ' ')) AS cleaned, coalesce(nullif(string_split(text, ' ')[1], ''), 'UNKNOWN') AS head FROM conversations")
def scalar_helpers(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", model_slug(F.concat(F.lit("org/"), "role")).alias("slug"),
        F.upper(strip(F.concat(F.lit("  "), "role", F.lit(" ")))).alias("cleaned"),
        F.coalesce(F.nullif(F.get(F.split(text, " "), F.lit(0)), F.lit("")), F.lit("UNKNOWN")).alias("head"),
    )


@query(fx.sql("SELECT conv_id, conv_vol_idx, i FROM (SELECT *, row_number() OVER (ORDER BY conv_id, conv_vol_idx) - 1 AS i FROM volleys) WHERE i >= 10 AND i < 35", "volleys"))
def row_range(spark, sf):
    rows = running_index(fx.volleys(spark, sf), ["conv_id", "conv_vol_idx"], "i")
    return read_rows(rows, "i", 10, 25).select("conv_id", "conv_vol_idx", "i")


@query(fx.sql("SELECT 'd' AS dataset, CAST(conv_id AS VARCHAR) AS conv_id, speaker, md5(utt_text) AS utt_md5, t1_gold AS t1_label, CAST(NULL AS VARCHAR) AS t2_label FROM coded", "coded"))
def normal_form(spark, sf):
    rows = as_normal_form(fx.coded(spark, sf), "d", "t1_gold", "no_such_column")
    return rows.select("dataset", "conv_id", "speaker", F.md5("utt_text").alias("utt_md5"), "t1_label", "t2_label")
