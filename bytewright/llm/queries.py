"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, minhash, mixing, passages, pii, warc
from .common import table
from .embeddings import embedding_duplicates
from .media import sniff_media, stored, text_media
from .minhash import near_duplicates
from .packing import PackParams, pack_documents
from .passages import passage_digests, remove_repeated_passages
from .secret_scan import KINDS, scan_secrets
from .toxicity import fit_toxicity, held_out, score_toxicity


def word_tokenizer() -> str:
    """The tokenizer file that the queries pack with; elsewhere its path is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def _piece_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    crc = [zlib.crc32(ids.values.to_numpy().astype("<u4").tobytes()) for ids in batch.column("ids")]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    packed = pack_documents(table(spark, sf_dir, "documents"), PackParams(word_tokenizer()), _piece_digests, schema)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _media_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for media, payload, actual, fixed, rate, bits, parts in zip(*(batch.column(c).to_pylist() for c in ("media", "payload", "actual", "corrected", "rate", "bits", "parts"))):
        inner = ",".join(f"{p['type']}@{p['start']}-{p['end']}" for p in parts if p["start"])
        level = sum(payload) / len(payload)
        feature = f"{actual};corrected={int(fixed)};rate={rate};bits={bits};samples={len(payload)};mean={level:.3f};embedded={inner}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], names=["doc_id", "n_bytes", *names])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniff_media(stored(text_media(table(spark, sf_dir, "documents"))), finish=_media_digests, schema=schema)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    kept = F.filter("secrets", lambda s: s["base"])
    counts = [_count_of(kept, k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(kept), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(remove_repeated_passages(table(spark, sf_dir, "documents")))


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count_of(F.col("base"), k) for k in pii.KINDS]
    digest = F.sha2(pii.sanitized_text(), 256).alias("sanitised_sha256")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"), digest)


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 8: its base spans."""
    return op8_secret_scan(spark, sf_dir).drop("spans")


def personal_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 10: its base spans."""
    return op10_pii_sanitisation(spark, sf_dir).drop("spans", "sanitised_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 5: the payloads read back and the stored form."""
    return op5_media_columns(spark, sf_dir).drop("feature")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql_spans(kind: str, pattern: str, valid: str) -> str:
    """SQL for the valid matches of one pattern: matches are marked, then the text is split at the marks."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
      SELECT doc_id, p[i] AS m, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS s FROM (
        SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (
          SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), chr(2)), '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM documents))) WHERE {valid}"""


def _sql_base(kinds: dict[str, tuple[str, str]], order: str) -> str:
    spans = " UNION ALL ".join(_sql_spans(k, *v) for k, v in kinds.items())
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in kinds)
    place = "list_position([" + ", ".join(f"'{k}'" for k in kinds) + "], kind)"
    return f"""WITH spans AS ({spans})
    SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order.format(kind=place)}), '')) AS base_sha256
    FROM documents d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id"""


# The patterns of operators 8 and 10 as their contract states them.
_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SQL_SECRETS = {"assign": (_ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"), "hex": ("[0-9a-f]+", "length(m) >= 32")}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"(SELECT list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INTEGER) ELSE CAST({_DIGITS}[-i] AS INTEGER) * 2 - CASE WHEN CAST({_DIGITS}[-i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
_SQL_PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}
_LE = "printf('%02X%02X%02X%02X', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"
_SQL_MEDIA = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, t || repeat(chr(0), CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END) AS t, CASE WHEN n = 0 THEN 64 ELSE (n + 63) // 64 * 64 END AS size FROM d),
crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
h AS (SELECT *, hex(encode(t)) AS x FROM p),
m AS (SELECT *, '52494646' || {_LE.format("(size + 36)")} || '57415645666D7420' || '10000000' || '01000100' || '401F0000' || '401F0000' || '01000800' || '64617461' || {_LE.format("size")} || x AS media FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(t) AS payload_sha256,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(right(x, 128), '..'), lambda y: CAST('0x' || y AS BIGINT))), lambda c, y: xor(crc[CAST(xor(c, y) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::BIGINT) AS tail_crc32,
  CAST(size + 44 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256
FROM m, crc
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_media_columns": op5_media_columns,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_pii_sanitisation": op10_pii_sanitisation,
    "media_payloads": media_payloads,
    "secret_base_spans": secret_base_spans,
    "personal_base_spans": personal_base_spans,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.ORACLE,
    "op2_embedding_near_dedup": embeddings.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
    "op9_substring_dedup": passages.ORACLE,
    "media_payloads": _SQL_MEDIA,
    "secret_base_spans": _sql_base(_SQL_SECRETS, "s, {kind}"),
    "personal_base_spans": _sql_base(_SQL_PERSONAL, "{kind}, s"),
}
