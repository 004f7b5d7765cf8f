"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is matched. Candidates' hashes are counted over distinct
owners and repositories of the corpus: what many owners have is a widely copied
example; what few have, and looks random, is a credential in use. Texts are not
shuffled; only rows with candidates, without their text, are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, join_split, materialize, read_table, text_or_empty

KINDS = ("assign", "access", "hex", "token")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
#: A match of too few characters is dropped after matching. For access and hex, runs are maximal, so the least length may stand in the pattern.
PATTERNS = {
    "assign": rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "token": "[A-Za-z0-9+/_-]{20,}",
}
ASSIGN_CHARS, TOKEN_DISTINCT = 6, 10


def _maybe(text: Column, kind: str) -> Column:
    """Cheap conditions without which a text has no match."""
    if kind == "assign":
        return (text.contains("=") | text.contains(":")) & text.rlike(PATTERNS[kind])
    if kind == "access":
        return text.contains("AKIA") & text.rlike(PATTERNS[kind])
    if kind == "token":
        return text.rlike("[0-9]") & text.rlike(PATTERNS[kind])
    return text.rlike(PATTERNS[kind])


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, k, kind, end, value) of a kind: code points, end exclusive.

    Splitting at the pattern gives what lies between its matches, so starts
    are running sums of lengths.
    """
    pattern = F.lit(PATTERNS[kind])
    whole, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else whole
    one = "struct<start:long,k:int,kind:string,end:long,value:string>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{one}>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(F.get(between, acc["i"]))
        end = at + F.length(m)
        item = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), end.alias("end"), F.get(value, acc["i"]).alias("value"))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(item)).alias("out"))

    found = F.aggregate(whole, start, step, lambda acc: acc["out"])
    if kind == "assign":
        found = F.filter(found, lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    if kind == "token":
        looks = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.regexp_extract_all(v, F.lit("."), F.lit(0)))) >= TOKEN_DISTINCT)
        found = F.filter(found, lambda s: looks(s["value"]))
    return F.when(_maybe(text, kind), found).otherwise(F.array().cast(f"array<{one}>"))


def candidate_spans(text: Column) -> tuple[Column, Column]:
    """Base spans, and the further candidates that touch none of them."""
    base = F.array_sort(F.concat(*[_matches(text, k) for k in KINDS[:3]]))
    more = _matches(text, "token")
    return base, F.filter(more, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _joined(spans: Column) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def text_key(text: Column) -> Column:
    """128 bits of hash, so that different texts do not share spans."""
    return F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text)))


def find_spans(documents: DataFrame, owner: Column, repository: Column, max_owners: int = 2, max_repositories: int = 3, text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(row_key, base, added, n_owned, n_shared) of each different row that has candidates.

    ``row_key`` is ``key``, by default a hash of the text. base and added are arrays of
    (start, k, kind, end, value); n_owned and n_shared count the base spans
    whose value is specific to few owners, or copied among many.
    """
    text = text_or_empty(text_col)
    base, more = candidate_spans(text)
    rows = documents.select((text_key(text) if key is None else key).alias("row_key"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repo"), base.alias("base"), more.alias("more"))
    rows = materialize(rows.filter((F.size("base") > 0) | (F.size("more") > 0)), "candidates")
    each = F.explode(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("digest"))))
    spans = rows.select("row_key", "owner", "repo", each.alias("s"))
    owned = spans.groupBy(F.col("s.digest").alias("digest"), "owner", "repo").agg(F.count("*").alias("n"))
    owners = owned.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    wide = owners.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("copies"))
    wide = wide.select("digest", "copies", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories)).alias("specific"))
    once = spans.select("row_key", "s.*").distinct()
    judged = join_split(once, wide, "digest", "copies").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "k", "kind", "end", "specific"))).alias("all"))
    is_base = lambda s: s["k"] < 3
    return judged.select(
        "row_key",
        F.filter("all", is_base).alias("base"),
        F.filter("all", lambda s: ~is_base(s) & s["specific"]).alias("added"),
        F.size(F.filter("all", lambda s: is_base(s) & s["specific"])).cast("long").alias("n_owned"),
        F.size(F.filter("all", lambda s: is_base(s) & ~s["specific"])).cast("long").alias("n_shared"),
    )


def scan_secrets(documents: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts by kind, digest of base spans, all spans.

    A repository is the tuple of ``repository_cols``. Null text counts as
    empty: no spans. A null owner is an owner of its own. Repeated rows count once
    each; texts that are equal have equal spans. Other columns are ignored.
    """
    text = text_or_empty(text_col)
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_cols])
    found = find_spans(documents, F.col(owner_col), repo, text_col=text_col)
    rows = documents.select(F.col(id_col).alias("doc_id"), text_key(text).alias("row_key"))
    joined = join_split(rows, materialize(found, "spans"), "row_key", how="left")
    empty = F.array().cast(found.schema["base"].dataType)
    base, added = F.coalesce("base", empty), F.coalesce("added", empty)
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.array_sort(F.concat(base, added))).alias("spans"), zero("n_owned"), zero("n_shared"))


def redact_secrets(documents: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each span of a text (overlapping ones as one) replaced by ``mark``.

    Rows without candidates, null texts among them, pass unchanged and unshuffled.
    """
    text = F.col(text_col)
    may = F.coalesce(reduce(lambda a, b: a | b, [_maybe(text, k) for k in KINDS]), F.lit(False))
    name = fresh_name(documents, "row_key")
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_cols])
    some = documents.filter(may)
    found = find_spans(some, F.col(owner_col), repo, text_col=text_col)
    spans = found.select(F.col("row_key").alias(name), F.array_sort(F.concat("base", "added")).alias(fresh_name(documents, "spans")))
    joined = some.withColumn(name, text_key(text)).join(spans, name, "left")
    at, out = F.lit(0).cast("long").alias("at"), F.lit("").alias("out")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(joined.columns[-1], F.struct(at, out), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    done = joined.withColumn(text_col, F.coalesce(clean, text)).select(*documents.columns)
    return documents.filter(~may).unionByName(done)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def _sql_matches(kind: str) -> str:
    p = PATTERNS[kind].replace("'", "''").replace("\\\"", '"')
    g = 2 if kind == "assign" else 0
    keep = {"assign": f"length(v) >= {ASSIGN_CHARS}", "token": f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(regexp_extract_all(v, '.'))) >= {TOKEN_DISTINCT}"}.get(kind, "true")
    return f"""
      SELECT doc_id, {KINDS.index(kind)} AS k, '{kind}' AS kind, s, s + length(m) AS e, v FROM (
        SELECT doc_id, m[i] AS m, v[i] AS v,
               list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
        FROM (SELECT doc_id, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS b
          FROM d WHERE regexp_matches(t, '{p}'))))
      WHERE {keep}"""


def op2_sql() -> str:
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
                      coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
    base AS ({" UNION ALL ".join(_sql_matches(k) for k in KINDS[:3])}),
    more AS (SELECT * FROM ({_sql_matches("token")}) x WHERE NOT EXISTS (
      SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
    every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
    wide AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM every JOIN d USING (doc_id) GROUP BY v),
    judged AS (SELECT every.*, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS one, (owners <= 2 AND repos <= 3) AS specific FROM every JOIN wide USING (v)),
    docs AS (SELECT doc_id,
      count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      coalesce(string_agg(one, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
      coalesce(string_agg(one, ',' ORDER BY s, k) FILTER (k < 3 OR specific), '') AS spans,
      count(*) FILTER (k < 3 AND specific) AS n_owned, count(*) FILTER (k < 3 AND NOT specific) AS n_shared
      FROM judged GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_owned, 0) AS n_owned, coalesce(n_shared, 0) AS n_shared
    FROM d LEFT JOIN docs USING (doc_id)"""
