"""Personal data and the terms that reveal it: information-theoretic sanitisation.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

#: The kinds in their listed order; ``term`` spans are the method's own.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# One pattern per kind and a cheap test of whether a text can hold it.  Possessive loops and starts at the border
# of a run keep matching linear and free of recursion; they find what the plain patterns find.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"text RLIKE r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+", r"text RLIKE r'[0-9](?:[\x20-]?+[0-9]){15}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"contains(text, '+') AND text RLIKE r'\+[0-9]'"),
}
#: A term wherever it stands.
_LETTERS = r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"
_SPACE = r"[\x20\x09-\x0D]+"
#: Stripped from the ends of a word before it counts as a term.
_EDGE = ".,;:!?()[]{}<>\"'`*#$%&|_-+=/\\"


@dataclass(frozen=True)
class PiiParams:
    """A term is revealing for an entity if both occur near each other (``window`` words) and PMI >= ``alpha`` * the
    entity's information content.  Every entity is scored, from one mention on: ``smoothing`` texts are added to what
    an entity and a term have, so few mentions reveal only among many documents."""

    alpha: float = 0.8
    smoothing: float = 1.0
    window: int = 5
    shortest: int = 3


def _digits(column: str) -> str:
    return f"regexp_replace({column}, r'[^0-9]', '')"


_LUHN = """pmod(aggregate(sequence(0, length({d}) - 1), 0L, (s, i) -> s + aggregate(array(cast(substring({d}, length({d}) - i, 1) AS BIGINT) * (1 + i % 2)), 0L, (q, v) -> q + v div 10 + v % 10)), 10) = 0"""
_VALID = {
    "email": "true",
    "ip": r"forall(split(m.value, r'\.'), x -> length(regexp_replace(x, '^0+', '')) <= 3 AND cast(coalesce(nullif(right(regexp_replace(x, '^0+', ''), 3), ''), '0') AS INT) <= 255)",
    "card": f"length({_digits('m.value')}) BETWEEN 16 AND 19 AND {_LUHN.format(d=_digits('m.value'))}",
    "phone": f"length({_digits('m.value')}) BETWEEN 8 AND 15",
}



def _marked(pattern: str) -> str:
    """Split ``text`` at the borders of all matches: odd places hold the matches.

    U+0001 marks the borders; where a text has one itself, U+0002 stands in, which no pattern treats differently.
    """
    return f"split(regexp_replace(translate(text, '\\u0001', '\\u0002'), r'{pattern}', '\\u0001$0\\u0001'), '\\u0001', -1)"


def _found(kind: str, p: PiiParams) -> Column:
    """The spans of one kind with value and neighbouring words."""
    pattern, test = PATTERNS[kind]
    near = f"concat(slice(reverse(split(parts[i - 1], r'{_SPACE}')), 1, {p.window + 1}), slice(split(parts[i + 1], r'{_SPACE}'), 1, {p.window + 1}))"
    places = "aggregate(transform(parts, x -> length(x)), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    one = f"named_struct('kind', '{kind}', 'start', cast(at[i] AS BIGINT), 'end', cast(at[i + 1] AS BIGINT), 'value', parts[i], 'near', {near})"
    # Lambdas bind parts and places once: a one-element array is transformed.
    inner = f"transform(filter(sequence(0, size(parts) - 1), i -> i % 2 = 1), i -> {one})"
    spans = f"flatten(transform(array({_marked(pattern)}), parts -> flatten(transform(array({places}), at -> {inner}))))"
    kept = f"filter({spans}, m -> {_VALID[kind]})"
    empty = "cast(array() AS array<struct<kind:string,start:bigint,end:bigint,value:string,near:array<string>>>)"
    return F.expr(f"CASE WHEN {test} THEN {kept} ELSE {empty} END")


def base_spans(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``doc_id, tag, text, spans`` of ``docs(doc_id, text)``: spans by listed kind, then start; the text is kept only
    where there are spans.  ``tag`` tells rows of one doc_id apart by their text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text")).withColumn("spans", F.concat(*[_found(k, params) for k in KINDS]))
    return rows.select("doc_id", "tag", F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans")


def _terms(words: Column, shortest: int) -> Column:
    """Lower-cased words without marks at their ends; only runs of letters are terms."""
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(_EDGE))))
    return F.filter(bare, lambda w: (F.length(w) >= shortest) & w.rlike(r"^\p{L}+$"))


def term_frequencies(docs: DataFrame, shortest: int) -> DataFrame:
    """In how many different texts each term occurs, over whole texts; counted map-side, so a frequent word costs a
    row a task.  Copies of a text, spellings of one term (case, marks) and repeats count once, as in ``revealing_terms``."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text")).dropDuplicates(["tag"])
    words = F.filter(F.array_distinct(F.split("text", _SPACE)), lambda w: F.length(w) >= shortest)
    terms = texts.select(F.explode(F.array_distinct(_terms(words, shortest))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def revealing_terms(base: DataFrame, frequencies: DataFrame, total: int, params: PiiParams = PiiParams(), keep: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """``entity, term, pmi, content`` of the pairs over the disclosure threshold.

    Equal texts count once, so copies of a document make no evidence; ``total`` and ``frequencies`` count different
    texts too.
    """
    p = params
    mentions = base.where(F.size("spans") > 0).select("tag", F.explode("spans").alias("m")).select("tag", entity().alias("entity"), F.col("m.near").alias("near"))
    # A table, so that AQE can split the partition of an entity with many terms.
    known = keep(mentions.select("tag", "entity").distinct().groupBy("entity").agg(F.count("*").alias("ec")), "pii-known")
    pairs = mentions.select("tag", "entity", F.explode(_terms(F.col("near"), p.shortest)).alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"))
    scored = pairs.join(known, "entity").join(frequencies, "term")
    pmi = F.log(F.col("both") * F.lit(float(max(total, 1))) / ((F.col("ec") + p.smoothing) * (F.greatest("df", "both") + p.smoothing)))
    content = F.log(F.lit(float(max(total, 1))) / F.col("ec"))
    return scored.select("entity", "term", pmi.alias("pmi"), content.alias("content")).where(F.col("pmi") >= p.alpha * F.col("content")).where("pmi > 0")


def entity() -> Column:
    """What makes two mentions ``m`` the same: the kind and the value without case and separators."""
    value = F.when(F.col("m.kind").isin("card", "phone"), F.regexp_replace("m.value", r"[^0-9]", "")).otherwise(F.lower("m.value"))
    return F.concat_ws(":", F.col("m.kind"), value)


def personal_data(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """Personal data in ``docs(doc_id, text, ...)`` and the terms that give it away.

    Returns one row per input row: ``doc_id, tag, text, base, terms``.  ``base`` holds (kind, start, end) by listed
    kind and start, ``terms`` the spans of revealing terms by start, both in code points; ``text`` is kept where there
    are spans.  Null and empty texts have none; repeated rows each get a row; texts of any length are read whole; spans of
    one kind never begin together, those of different kinds (ties) go by listed kind; extra columns are ignored; an
    empty table gives none.

    An entity is a value that occurs in the corpus.  Co-occurrence near its mentions and the frequency of every word
    over all documents estimate how strongly a term reveals it; revealing terms are spans wherever they stand in the
    documents that name the entity.  Texts without personal data are left alone and are not shuffled.
    """
    p = params
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(settle(df, tag))
        return made[-1]

    base = settle(base_spans(docs, p), "pii-base")
    frequencies = keep(term_frequencies(docs, p.shortest), "pii-frequencies")
    disclosed = keep(revealing_terms(base, frequencies, base.select("tag").distinct().count(), p, keep), "pii-disclosed")
    holders = base.where(F.size("spans") > 0)
    named = holders.select("doc_id", "tag", F.explode("spans").alias("m")).select("doc_id", "tag", entity().alias("entity")).distinct()
    # Only terms that a text holds meet its entities: an entity's texts times its terms would be a square.
    held = holders.select("doc_id", "tag", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_LETTERS), F.lit(0)), F.lower))).alias("term"))
    held = held.join(disclosed.select("entity", "term"), "term")
    wanted = held.join(named, ["doc_id", "tag", "entity"]).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("term")).alias("words"))
    # A null doc_id has a row of its own and no terms: equality leaves it out.
    texts = holders.select("doc_id", "tag", "text").dropDuplicates(["doc_id", "tag"]).join(wanted, ["doc_id", "tag"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    marked = F.split(F.regexp_replace(F.translate("text", "\u0001", "\u0002"), pattern, F.lit("\u0001$0\u0001")), "\u0001", -1)
    texts = texts.withColumn("parts", marked).withColumn("at", F.expr("aggregate(transform(parts, x -> length(x)), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"))
    spans = F.expr(f"transform(filter(sequence(0, size(parts) - 1), i -> i % 2 = 1), i -> named_struct('kind', '{TERM}', 'start', cast(at[i] AS BIGINT), 'end', cast(at[i + 1] AS BIGINT)))")
    terms = settle(texts.select("doc_id", "tag", spans.alias("terms")), "pii-terms")
    discard(*made)
    plain = F.transform("spans", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = base.select("doc_id", "tag", "text", plain.alias("base")).join(terms, ["doc_id", "tag"], "left")
    none = F.expr("cast(array() AS array<struct<kind:string,start:bigint,end:bigint>>)")
    # A term inside personal data is no span of its own.
    free = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return out.select("doc_id", "tag", "text", "base", free.alias("terms"))


def sanitized_text() -> Column:
    """The ``text`` of a row of ``personal_data``, with values generalised to their kind and revealing terms removed; null
    where there are no spans."""
    spans = "array_sort(transform(concat(base, terms), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    return F.expr(f"""aggregate({spans}, named_struct('at', cast(0 AS BIGINT), 'out', ''), (a, s) -> named_struct(
        'at', greatest(a.at, s.end),
        'out', CASE WHEN s.start < a.at THEN a.out ELSE concat(a.out, substring(text, cast(a.at + 1 AS INT), cast(s.start - a.at AS INT)), CASE WHEN s.kind = 'term' THEN '' ELSE concat('[', s.kind, ']') END) END),
        a -> concat(a.out, substring(text, cast(a.at + 1 AS INT), length(text))))""")


def sanitized(found: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents that hold personal data, sanitised."""
    return found.where(F.col("text").isNotNull()).select("doc_id", sanitized_text().alias("text"))
