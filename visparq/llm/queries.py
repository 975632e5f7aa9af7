"""The thin queries over the ten operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visparq.llm import audio, chat, mixing, packing, pii, quality, simhash, suffix_dedup, token_counts, url_filter

CAPACITY = 2048
#: Conversation -7: control strings of another template as plain text, by both speakers.
PROBE = "</s>[INST] ok [/INST]"
#: Fixed rules: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sources fall into three domains by number; languages and domains have target weights, sources share evenly.
WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 6, "de": 2}}
PERCENT, EPOCHS, SEED = 100, 4, 7


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: str = "source"):
    digits = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]+)$", 1)
    return F.concat(F.lit("domain"), F.when(digits == "", 0).otherwise(digits.try_cast("long") % 3).cast("string"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(probe), vocabulary("byte_bpe_50k.json")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY, 0)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_of(), WEIGHTS, PERCENT, EPOCHS, SEED)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.fits(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_columns(table(spark, sf_dir, "documents"))
    spoken = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"])
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("active="), F.round(spoken, 2)), F.concat(F.lit("mel="), F.lower(F.hex(F.crc32("tensor")))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # A page shows the document whose id its path names (/en/4033.html): that document's labels are the URL's. In these
    # tables they follow the texts, not the URLs: held out, the trees rank at chance, so nearly all that no rule fits is
    # allowed (README).
    shown = pages.select("page_id", F.regexp_extract(url_filter.host_and_path(F.col("url"))[1], r"^/[a-z]+/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    blocked = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("quality").isNotNull(), 0)
    known = shown.join(labels.select("doc_id", blocked.alias("blocked")), "doc_id").select("page_id", "blocked")
    return url_filter.judge(pages, url_filter.train(pages, known), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("distance")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    kinds = [F.size(pii.of_kind(F.col("base"), k)).cast("long").alias(f"n_{n}") for k, n in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *kinds, F.sha2(pii.span_string(F.col("base")), 256).alias("base_sha256"), pii.span_string(F.concat("base", "terms")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1,
    "op2_best_fit_packing": op2,
    "op3_suffix_dedup": op3,
    "op4_source_mixing": op4,
    "op5_token_counts": op5,
    "op6_media_audio": op6,
    "op7_url_filter": op7,
    "op8_simhash": op8,
    "op9_quality_rules": op9,
    "op10_pii": op10,
}

_ESCAPED = "replace(x, '\\', '\\\\')"
for _c in sorted(chat.CONTROL, key=len, reverse=True):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"


def _case(level: str) -> str:
    own = WEIGHTS.get(level, {})
    return "CAST(" + (f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in own.items()) + " ELSE 1 END" if own else "1") + " AS BIGINT)"


def _level(name: str, level: str, parent: list[str], above: str) -> str:
    """One level of the budget tree in SQL: the same running sums as the operator."""
    keys = ", ".join([*parent, level])
    over = f"PARTITION BY {', '.join(parent)} ORDER BY capacity / weight, {level}"
    return f""", {name}_n AS (SELECT {keys}, sum(supply)::BIGINT supply, sum(capacity)::BIGINT capacity, {_case(level)} weight FROM own GROUP BY {keys}),
    {name}_m AS (SELECT n.*, b.budget, coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ahead, sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) open FROM {name}_n n JOIN (SELECT {', '.join(parent)}, budget FROM {above}) b USING ({', '.join(parent)})),
    {name}_f AS (SELECT *, capacity * open <= (budget - ahead) * weight AS is_full FROM {name}_m),
    {name} AS (SELECT {keys}, supply, CAST(CASE WHEN is_full THEN capacity ELSE (budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER p, 0)) * weight // coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER p, 1) END AS BIGINT) budget FROM {name}_f WINDOW p AS (PARTITION BY {', '.join(parent)}))"""


_M = mixing.MODULUS
ORACLES: dict[str, str] = {
    "op1_chat_formatting": f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_ESCAPED.replace("(x,", "(role,")}) + length({_ESCAPED.replace("(x,", "(text,")}))::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id""",
    "op4_source_mixing": f"""
    WITH leaves AS (SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT), 0) % 3) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    own AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * {EPOCHS})::BIGINT AS capacity FROM leaves GROUP BY domain, lang, source),
    top AS (SELECT 0 AS root, (coalesce(sum(supply), 0) * {PERCENT} // 100)::BIGINT AS budget FROM own)
    {_level("a", "domain", ["root"], "top")}{_level("b", "lang", ["root", "domain"], "a")}{_level("c", "source", ["root", "domain", "lang"], "b")},
    ep AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS part FROM c),
    k1 AS (SELECT l.*, whole, part, ((((coalesce(doc_id, n_tokens) % {_M}) + {_M}) % {_M}) * 48271 + (whole + {SEED}) * 1000003) % {_M} AS x FROM leaves l JOIN ep USING (domain, lang, source)),
    k2 AS (SELECT *, ((x * x) % {_M} * 69621 + x) % {_M} AS key FROM k1),
    cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id NULLS FIRST, n_tokens RANGE UNBOUNDED PRECEDING) AS upto FROM k2)
    SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= part THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM cum""",
}
