"""Secret scan with corpus-wide ownership frequency (operator 7), in DataFrame functions only.

Patterns find candidates: assignments to a secret's name, access keys, long hexadecimal strings, and
beyond these any long token in which letters and digits alternate.  What the corpus says about a
candidate decides what it is: its value is aggregated by distinct repositories and distinct owners.  A
value that several owners or several repositories hold is a widely copied example; another looks live.
Equal texts count once, for the least repository and owner among them: a copied document doesn't make its
tokens widely copied.  Near copies count as texts of their own.

Spans of the three base patterns are always reported.  The method adds the spans of other tokens that
look live (kind ``owned``), where they don't overlap a base span, and gives its verdict on each candidate.

Positions come from the pieces between matches: the regular expression's matches and the pieces it
splits a text into alternate, so running sums of their lengths are the matches' places.  The sums and
the search for overlaps are windows over the matches of a text, so a text costs in proportion to its
length and its matches (times their logarithm).  Positions are code points.

Counts are combined before they are shuffled (by value, repository and owner, then by value), and verdicts
reach the matches by value and share (``spread``), so no task gets all matches of a common value.  Nulls: a
null text is empty and has no span; null repositories and owners are the value ''.  Repeated rows are
separate documents, with equal results.  An empty table gives an empty result.  Very long texts are scanned
whole.  Only the named columns are read; others, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import spread, table, written

#: Kinds in the order in which they are listed, with their patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
OTHER = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "owned")
_PATTERNS = ((ASSIGN, 6), (ACCESS, 20), (HEX, 24), (OTHER, 16))
#: A token is a candidate of kind ``owned`` if letters and digits meet in it so many times.
TURNS = 4
SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


def _pieces(text: Column, pattern: str, kind: int) -> Column:
    """The matches in order as structs (kind, k, gap before the match, size, value)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), hits, lambda b, h: F.struct(F.length(b).alias("gap"), h.alias("hit")))
    held = lambda h: F.regexp_extract(h, pattern, 1) if "([" in pattern else h
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), x["gap"].alias("gap"), F.length(x["hit"]).alias("size"), held(x["hit"]).alias("value"))
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(F.filter(pieces, lambda x: x["hit"].isNotNull()), one))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (_v_row, doc_id), and their candidates (_v_row, repository, owner, digest of the text, start,
    kind, end, value): matches of the base patterns, and further tokens that overlap none of them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = docs.select(
        F.monotonically_increasing_id().alias("_v_row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(repository if repository is not None else F.col("source"), F.lit("")).alias("repository"),
        F.coalesce(owner if owner is not None else F.col("source"), F.lit("")).alias("owner"),
        text.alias("_t"),
    )
    hits = F.array_compact(F.array(*[_pieces(F.col("_t"), pattern, kind) for kind, (pattern, _) in enumerate(_PATTERNS)]))
    told = told.withColumn("hits", hits).withColumn("digest", F.when(F.size("hits") > 0, F.sha2(F.col("_t").cast("binary"), 256)))
    told = written(told.drop("_t"), "matches")
    each = told.filter(F.size("hits") > 0).select("_v_row", "repository", "owner", "digest", F.explode(F.flatten("hits")).alias("m")).select("_v_row", "repository", "owner", "digest", "m.*")
    order = Window.partitionBy("_v_row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    least = F.get(F.array(*[F.lit(n) for _, n in _PATTERNS]), F.col("kind"))
    turns = F.regexp_count("value", F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"))
    each = each.filter((F.length("value") >= least) & ((F.col("kind") < 3) | (turns >= TURNS)))
    # a token overlaps a base span if one that starts before the token's end ends after its start: the greatest end
    # so far, with base spans placed at their starts and tokens at their ends (first, where both are equal)
    base = F.col("kind") < 3
    placed = each.withColumn("_at", F.when(base, F.col("start")).otherwise(F.col("end")))
    sofar = Window.partitionBy("_v_row").orderBy("_at", F.when(base, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_upto", F.max(F.when(base, F.col("end"))).over(sofar))
    found = placed.filter(base | F.col("_upto").isNull() | (F.col("_upto") <= F.col("start")))
    return told.select("_v_row", "doc_id"), written(found.select("_v_row", "repository", "owner", "digest", "start", "kind", "end", "value"), "candidates")


def ownership(found: DataFrame, most_owners: int = 2, most_repositories: int = 2) -> DataFrame:
    """(value, texts, repositories, owners, live) over the corpus of distinct texts: live values have few of both."""
    texts = found.groupBy("digest", "value").agg(F.min(F.struct("repository", "owner")).alias("h"))
    held = texts.groupBy("value", F.col("h.repository").alias("repository"), F.col("h.owner").alias("owner")).agg(F.count("*").alias("n"))
    repositories = held.groupBy("value", "repository").agg(F.sum("n").alias("n")).groupBy("value").agg(F.sum("n").alias("texts"), F.count("*").alias("repositories"))
    owners = held.groupBy("value", "owner").agg(F.count("*").alias("_n")).groupBy("value").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "value").withColumn("live", (F.col("owners") < most_owners) & (F.col("repositories") < most_repositories))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, most_owners: int = 2, most_repositories: int = 2
) -> DataFrame:
    """(doc_id, base, added, verdicts, n_live, n_example): spans of every document, the verdict on each candidate
    (with the texts, repositories and owners that hold its value), and how many look live or are widely copied."""
    rows, found = candidates(docs, id_col, text_col, repository, owner)
    verdicts = ownership(found, most_owners, most_repositories)
    each = spread(found.select("_v_row", "start", "kind", "end", "value"), verdicts, ["value"], ["_v_row"])
    span = F.struct("start", "kind", "end", "value")
    judged = each.groupBy("_v_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), span))).alias("added"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "texts", "repositories", "owners", "live"))).alias("verdicts"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    none = F.expr(f"cast(array() as {SPANS})")
    unjudged = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, texts: bigint, repositories: bigint, owners: bigint, live: boolean>>)")
    zero = F.lit(0).cast("long")
    return rows.join(judged, "_v_row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("verdicts", unjudged).alias("verdicts"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_secret_scan``: spans of secrets in every document.  A repository is a source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform("verdicts", lambda x: F.concat_ws(":", F.get(names, x["kind"]), *[x[c].cast("string") for c in ("start", "end", "texts", "repositories", "owners")], F.when(x["live"], "live").otherwise("example")))
    return found.select(
        "doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.array_join(told, ",").alias("verdicts"), "n_live", "n_example",
    )
