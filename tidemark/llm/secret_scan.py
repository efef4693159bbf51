r"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Fixed patterns give base spans (assign, access, hex). The value of each, and every other long
token with a digit, is a candidate; candidates are hashed and counted by distinct owners and
repositories over the corpus. A value that many owners or many repositories hold is a copied
example; one held by few of both, used as a secret at least once and not a placeholder, is a
live-looking credential, and every place where it stands as a token, with or without a keyword
before it, gets a ``live`` span. A token stands for its value: what follows its last inner ``=``,
without dots at its end, so ``id=VALUE`` and the ``VALUE.`` that ends a sentence are the VALUE.

Positions come from Java's own matcher without a UDF: ``split`` by the pattern and
``regexp_extract_all`` see the same matches, so running sums of both lengths give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage, text_of

#: Pattern, group of the value, least code points of the value.
ASSIGN = r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs that [0-9a-f]+ gives, less the short ones
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 0))
#: Code points of a live-looking value, at least.
LIVE_LENGTH = 12
#: A bare candidate: a whole run of a value's characters, with a digit in it.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}"
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|xxxx|1234567"

_MATCH = "array<struct<ord:int,lead:int,len:int,value:string>>"
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,owners:bigint,repos:bigint>>"


def _matches(text: Column, order: int, pattern: str, group: int) -> Column:
    """Of one kind, in order: code points between the match before and this one, its own, its value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # split keeps every piece with -1: one more than there are matches
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("lead"), whole.alias("m"), values.alias("v"))
    found = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(F.lit(order).alias("ord"), F.char_length(x["lead"]).alias("lead"), F.char_length(x["m"]).alias("len"), x["v"].alias("value")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_MATCH))


def looks_live(value: Column) -> Column:
    """Long enough, letters and digits mixed, several different characters, no placeholder word."""
    variety = F.size(F.array_distinct(F.split(value, "")))
    return (F.char_length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (variety >= 6) & ~value.rlike(PLACEHOLDER)


def joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _candidates(rows: DataFrame) -> DataFrame:
    """rid, owner, repo, and of each match that counts: ord, start, end, from, upto, h, looks.

    ``from`` and ``upto`` hold the value for which a token stands.
    """
    cand = rows.select("rid", "owner", "repo", F.posexplode("found").alias("pos", "m")).select("rid", "owner", "repo", "pos", "m.*")
    upto = Window.partitionBy("rid", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cand = cand.withColumn("end", F.sum(F.col("lead") + F.col("len")).over(upto).cast("int"))
    for order, (_, _, group, least) in enumerate(KINDS):
        size = F.char_length("value") if group else F.col("len")
        cand = cand.filter((F.col("ord") != order) | (size >= least))
    bare = F.rtrim("value", F.lit("."))
    stem = F.rtrim(bare, F.lit("="))
    inner = F.char_length(F.substring_index(stem, "=", -1)) + F.char_length(bare) - F.char_length(stem)
    cand = cand.withColumns({"_size": F.char_length("value"), "_bare": F.char_length(bare), "_inner": inner})
    cand = cand.withColumn("_all", F.col("_inner") == 0)  # nothing but dots and signs: the value as it is
    end = F.when(F.col("_all"), F.col("end")).otherwise(F.col("end") - F.col("_size") + F.col("_bare"))
    cand = cand.withColumns({"upto": end, "_inner": F.when(F.col("_all"), F.col("_size")).otherwise(F.col("_inner"))})
    value = F.substring("value", F.col("_size") - (F.col("end") - F.col("upto")) - F.col("_inner") + 1, F.col("_inner"))
    cand = cand.withColumn("stands", value)
    return cand.select(
        "rid", "owner", "repo", "ord", (F.col("end") - F.col("len")).alias("start"), "end", (F.col("upto") - F.col("_inner")).alias("from"), "upto",
        F.unhex(F.md5("stands")).alias("h"), looks_live(F.col("stands")).alias("looks"),
    )


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """Per row: doc_id, base (array of base spans), live (array of live spans), n_example.

    ``owner`` and ``repo`` (default: the column source, and source with lang) say who holds a
    document. A value with more than ``max_owners`` distinct owners, or in more than ``max_repos``
    distinct repositories, is an example; n_example counts the base spans with such values. Each
    span carries its value's owners and repos. Defined cases: null text is empty and has no spans;
    null owners count as one owner of their own; repeated rows each get their spans and don't
    raise the count of owners; an empty table gives no rows; other columns are ignored. Spans of a
    document stay in one row, as its text does.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.struct("source", "lang") if repo is None else repo
    text, bare = F.col("body"), len(KINDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(owner).alias("owner"), F.xxhash64(repo).alias("repo"), text_of(text_col).alias("body"))
    kinds = [_matches(text, i, p, g) for i, (_, p, g, _) in enumerate(KINDS)] + [_matches(text, bare, BARE, 0)]
    # the ids are written with the rows, so each later read sees the same ones
    rows = rows.select("doc_id", "owner", "repo", F.concat(*kinds).alias("found"), F.monotonically_increasing_id().alias("rid"))
    rows = stage(rows, "secret-matches")
    cand = stage(_candidates(rows), "secret-candidates")
    held = cand.groupBy("h", "owner", "repo").agg(F.max(F.col("ord") < bare).alias("used"), F.max("looks").alias("looks"))
    by_owner = held.groupBy("h", "owner").agg(F.max("used").alias("used"), F.max("looks").alias("looks"), F.count(F.lit(1)).alias("repos"))
    freq = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.max("used").alias("used"), F.max("looks").alias("looks"))
    wide = (F.col("owners") > max_owners) | (F.col("repos") > max_repos)
    freq = freq.filter("used").select("h", "owners", "repos", wide.alias("wide"), (F.col("looks") & ~wide).alias("live"))
    freq = stage(freq, "secret-frequencies")  # AQE splits the join below only over plain shuffles
    judged = cand.join(freq, "h")
    names = F.get(F.array(*[F.lit(k) for k, *_ in KINDS]), F.col("ord"))
    own = F.struct("start", "ord", "end", names.alias("kind"), "owners", "repos")
    live = F.struct(F.col("from").alias("start"), F.lit(bare).alias("ord"), F.col("upto").alias("end"), F.lit("live").alias("kind"), "owners", "repos")
    is_base = F.col("ord") < bare
    per_row = judged.filter(is_base | F.col("live")).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(is_base, own))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.col("live"), live))).alias("live"),
        F.count_if(F.col("wide") & is_base).alias("n_example"),
    )
    none = F.array().cast(_SPAN)
    found = rows.select("rid", "doc_id").join(per_row, "rid", "left")
    return found.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("live", none).alias("live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
