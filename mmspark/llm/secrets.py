"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns (assign, access, hex).  Each base value,
and each other long run of credential letters that mixes letters and digits,
is a candidate, known by its hash.  Candidates are counted over the corpus by
distinct repositories and owners: a value held by more than ``max_owners``
owners is a widely copied example, any other is specific to its owner and looks
live, however many of the owner's repositories hold it.  Without a known owner
(null or empty) repositories stand for owners: a value that more than
``max_repositories`` of those hold is an example too.  The method adds the spans of
live candidates that no base span overlaps, as kind ``bare``.

Plan: one pass over the texts finds the spans; only spans are kept (written to the
shared folder) and counted.  Counts are taken by (hash, owner) first, so a
value copied all over the corpus is summed before it meets in one task; the
flags come back by a join that deals a hot hash to several tasks.

Edge cases: a null text is empty; a null owner is the empty owner and a null
repository the empty one; repeated rows are rows of their own, of one
repository if they share the id; texts without spans give zero counts, an
empty ``spans`` and the hash of the empty text; other columns are ignored; an
empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mmspark.llm._spark import Steps, join_spread

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs of the allowed letters with the least length: the matches that pass, as a run is one match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
SPAN = "array<struct<start:int,kind:int,end:int,hash:bigint>>"


def _spans(text: Column, pattern: str, kind: int, least: int, group: int = 0, mixed: bool = False) -> Column:
    """The matches with at least ``least`` letters in the group, with code point positions.

    Matches and the pieces between them alternate, so a running sum of their
    lengths places each match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.split(text, pattern, -1)
    ok = lambda v: (F.char_length(v) >= least) & (v.rlike("[0-9]") & v.rlike("[A-Za-z]") if mixed else F.lit(True))
    zipped = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(pieces, 1, F.size(matches)).alias("p"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), F.xxhash64(x["v"]).alias("hash"))
        return F.struct(end.cast("int").alias("at"), F.when(ok(x["v"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, add, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def fingerprint(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def find(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """(row, doc_id, fingerprint, owner, repository, base, other): base spans and other candidates of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), text.alias("t"))
    t = F.col("t")
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0, 6, 2), _spans(t, ACCESS, 1, 20), _spans(t, HEX, 2, 24)))
    rows = rows.select("doc_id", fingerprint(t).alias("fingerprint"), "owner", "repository", base.alias("base"), _spans(t, BARE, 3, 20, mixed=True).alias("bare"))
    other = F.filter("bare", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "fingerprint", "owner", "repository", "base", other.alias("other"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 100) -> DataFrame:
    """One row a document: row, doc_id, fingerprint, base (spans), added (spans), live (the hashes of its live-looking values), n_live, n_examples."""
    steps = Steps(docs.sparkSession)
    found = steps.keep(find(docs, owner, repository))
    both = F.concat("base", "other")
    held = steps.keep(found.where(F.size(both) > 0).select("row", "owner", "repository", F.explode(F.array_distinct(F.transform(both, lambda x: x["hash"]))).alias("hash")))
    by_repository = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    counts = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum(F.when(F.col("owner") == "", F.col("repositories")).otherwise(0)).alias("repositories"))
    live = counts.where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("hash")
    mine = join_spread(held.select("row", "hash"), live, "hash", "row").groupBy("row").agg(F.collect_list("hash").alias("live"))
    out = found.join(mine, "row", "left").withColumn("live", F.coalesce("live", F.array().cast("array<long>")))
    added = F.filter("other", lambda x: F.array_contains("live", x["hash"]))
    n = F.size(F.array_distinct(F.transform("base", lambda x: x["hash"])))
    live_base = F.size(F.array_distinct(F.filter(F.transform("base", lambda x: x["hash"]), lambda h: F.array_contains("live", h))))
    return out.select("row", "doc_id", "fingerprint", "base", added.alias("added"), "live", live_base.cast("long").alias("n_live"), (n - live_base).cast("long").alias("n_examples"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (sorted by start; overlapping ones as one) replaced by the mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))).otherwise(text)
