r"""Secret scans: multipart credential linking with DataFrame functions only.

*Parts.* Each kind's pattern cuts a text in gaps and matches, unfolded to rows whose running lengths are the matches' places
(code points, end exclusive). ``assign``, ``access`` and ``hex`` are strong and always reported. ``id`` (account names),
``secret`` (long tokens of mixed letters and digits) and ``endpoint`` (addresses) are weak: on their own they say nothing.

*Linking.* The scope of a part reaches from ``reach`` code points before its start to ``reach`` after its end. An interval join
finds the parts that touch it: of those that start no later the farthest end, of those that start no earlier the nearest start,
by running windows over the document's parts sorted by place, so no pairs are formed. A weak id is
reported if a secret (assign, hex, secret) is in its scope, a weak secret if an identifier (access, id) is, an endpoint if
both are. A weak part that starts inside a strong one is part of it and not reported.

Null text counts as empty. Repeated rows stay repeated. An empty table gives an empty result. Only documents' keys and parts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm.common import two_hashes

REACH = 256


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ACCOUNTS = "|".join(map(either_case, ("access_?key_?id", "client_?id", "account", "username", "user", "login")))
VALUE = r"[A-Za-z0-9+/_.=-]"
TOKEN = "[A-Za-z0-9+/_-]"
#: kind: pattern, group, least characters of the group; in the order of the kinds
STRONG = {
    "assign": (rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?({VALUE}+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),  # the runs of 32 or more are all that is left of the runs
}
WEAK = {
    "id": (rf"""(?<![A-Za-z0-9])({ACCOUNTS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}}""", 0, 0),
    "secret": (rf"(?<!{TOKEN})(?={TOKEN}*[0-9])(?={TOKEN}*[A-Z])(?={TOKEN}*[a-z]){TOKEN}{{24,}}", 0, 0),
    "endpoint": (r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 0),
}
KINDS = [*STRONG, *WEAK]


def found(kind: str, text: Column) -> Column:
    """The kind's matches in order: (kind, nth, gap before, characters, good); empty for texts without one."""
    pattern, group, least = (STRONG | WEAK)[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), groups.alias("own")), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), x["gap"].alias("gap"),
        F.length(x["match"]).alias("chars"), (F.length(x["own"]) >= least).alias("good")))
    return F.when(F.rlike(text, F.lit(pattern)), F.slice(rows, F.lit(1), F.size(rows) - 1))


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, _h1, _h2, kind, nth, start, end) of all good matches, and one of kind -1 for each document row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,chars:int,good:boolean>>")
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("chars"),
                              F.lit(True).alias("good")))
    every = F.concat(itself, *[F.coalesce(found(kind, text), none) for kind in KINDS])
    rows = docs.select(F.col(id_col).alias("id"), *two_hashes(F.col(id_col), F.col(text_col)), F.explode(every).alias("p"))
    # a repeated row has the same parts once more: rows of one document are told apart by their number
    rows = rows.groupBy("id", "_h1", "_h2", "p").agg(F.count(F.lit(1)).alias("times")).select("id", "_h1", "_h2", "times", "p.*")
    after = F.sum(F.col("gap") + F.col("chars")).over(
        Window.partitionBy("_h1", "_h2", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", after).withColumn("start", F.col("end") - F.col("chars")).where("good")


def linked(all_parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts that are reported: strong ones, and weak ones whose complements lie in their scope."""
    kind = F.col("kind")
    is_kind = {name: kind == i for i, name in enumerate(KINDS)}
    before = Window.partitionBy("_h1", "_h2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_h1", "_h2").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def near(own: Column) -> Column:
        """Whether a part that is ``own`` touches the scope; those that start later end later, too."""
        ended = F.max(F.when(own, F.col("end"))).over(before) >= F.col("start") - reach
        starts = F.min(F.when(own, F.col("start"))).over(after) <= F.col("end") + reach
        return F.coalesce(ended, F.lit(False)) | F.coalesce(starts, F.lit(False))

    seen = all_parts.select(
        "*",
        near(is_kind["access"] | is_kind["id"]).alias("identifier"),
        near(is_kind["assign"] | is_kind["hex"] | is_kind["secret"]).alias("hidden"),
        F.max(F.when(kind.between(0, len(STRONG) - 1), F.col("end"))).over(before).alias("covered"),
    )
    free = F.coalesce(F.col("covered"), F.lit(0)) <= F.col("start")
    return seen.where(
        (kind < len(STRONG))
        | free & (is_kind["id"] & F.col("hidden") | is_kind["secret"] & F.col("identifier")
                  | is_kind["endpoint"] & F.col("identifier") & F.col("hidden"))
    ).drop("identifier", "hidden", "covered")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: id, digests of id and text, and ``spans``, an array of (start, kind, end), kinds by number."""
    span = F.struct("start", "kind", "end")
    rows = linked(parts(docs, id_col, text_col), reach).groupBy("id", "_h1", "_h2").agg(
        F.max(F.when(F.col("kind") < 0, F.col("times"))).cast("int").alias("times"),
        F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"))
    return rows.select("id", "_h1", "_h2", "spans", F.explode(F.sequence(F.lit(1), "times"))).select(
        F.col("id").alias(id_col), "_h1", "_h2", "spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < len(STRONG))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(STRONG)]
    return scanned.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
           reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span replaced by its kind in angle brackets; spans that overlap count as one.

    Texts without spans stay as they are; ``length_col`` is counted anew where a text changes. Only rows with spans
    are matched with the scan's, by digests of id and text.
    """
    spans = scan(docs, id_col, text_col, reach).where(F.size("spans") > 0).select("_h1", "_h2", "spans").dropDuplicates(["_h1", "_h2"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*two_hashes(F.col(id_col), F.col(text_col)), row).join(spans, ["_h1", "_h2"], "left")
    text, names = F.col("row")[text_col], F.array(*[F.lit(f"<{k}>") for k in KINDS])
    # spans that do not start beyond the end so far are swallowed by the span before them
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))

    def step(so_far: Column, s: Column) -> Column:
        fresh = s["start"] >= so_far["at"]
        gap = F.substring(text, (so_far["at"] + 1).cast("int"), (s["start"] - so_far["at"]).cast("int"))
        return F.struct(
            F.greatest(so_far["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(so_far["done"], gap, F.get(names, s["kind"]))).otherwise(so_far["done"]).alias("done"))

    clean = F.aggregate("spans", start, step, lambda x: F.concat(
        x["done"], F.substring(text, (x["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("spans").isNull(), text).otherwise(clean)
    changed = rows.select("row", F.col("spans").isNotNull().alias("hit"), new.alias("text"))
    return changed.select(*[
        F.col("text").alias(c) if c == text_col
        else F.when(F.col("hit"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c) if c == length_col
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ])
