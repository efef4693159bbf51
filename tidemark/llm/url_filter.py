"""URL filter by a sort-merge range join over reversed-host keys.

A host's canonical key is its labels in reverse order, each followed by a control character that
sorts below all that hosts hold; so a host with its subdomains is the interval of keys with that
prefix, and with a path behind it, so is a rule's path with all that it begins. Such intervals nest
or are disjoint. Two sorted sweeps find what is open at a URL's key:

* over hosts: the last host with rules carries the lengths of its parents' keys that have rules
  too; those that the URL's key begins with are the hosts whose rules may fit;
* over host and path, for each of these: starts and ends of the rules' intervals in one order with
  the URLs. The stack is kept as its top. A start's depth is the running sum of starts and ends; a
  rule's parent is the last start one level up, found by a sweep level by level; a start makes its
  rule the top and an end makes it the parent. The top at a URL is the longest rule that fits there.

The longest over all hosts of a URL decides. Sorted runs are range partitions, each of which gets
the top that is open at its first key, so one host or one rule with any share of the URLs spreads
over many of them, and no row ever holds more than one rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, running, stage, swept

#: Ends each label in a key. Hosts that hold it themselves can't match a rule by mistake: it
#: is doubled there with a mark that no rule has.
END = "\x01"
#: Between host and path, below all that follows a label.
PATH = "\x00"

_RULE = "struct<len:int,host_len:int,rule:string,verdict:string>"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(F.replace(host, F.lit(END), F.lit(END + "\x02")), r"\.", -1))
    return F.concat(F.array_join(labels, END), F.lit(END))


def url_filter(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (host + path, null if none fits), verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the URL's path
    starts with the rule's; the longest wins (by host and path together, then host, then the rule
    text). Without a fitting rule the verdict is ``default``. Defined cases: a null URL or one
    without ``://`` has empty host and path, which no rule with a path fits; a rule with a null
    host, path or verdict or an empty host is ignored; of rules equal in host and path a block
    wins; repeated rows each return; an empty table of pages gives no rows, and without rules all
    get the default; other columns are ignored.
    """
    r = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna().filter("host != ''")
    r = r.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"), F.min("verdict").alias("v"))
    r = r.select("host", "path", F.when(F.col("block"), "block").otherwise(F.col("v")).alias("verdict"), host_key(F.col("host")).alias("key"))
    r = stage(r, "url-rules")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # the ids are written with the rows, so each later read sees the same ones
    urls = stage(urls.withColumns({"key": host_key(F.col("host")), "rid": F.monotonically_increasing_id()}), "urls")

    probes = _on_hosts(urls, r).select(_at(F.col("own"), F.col("path")), F.lit(1).alias("url"), "rid", F.lit(None).cast(_RULE).alias("top"))
    met = swept(_edges(r).unionByName(probes), ["at", "url", "rid"], "top", "url-events").filter("url = 1 AND top.len IS NOT NULL")
    best = met.groupBy("rid").agg(F.max("top").alias("best"))
    got = urls.join(best, "rid", "left")
    return got.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _at(key: Column, path: Column) -> Column:
    return F.concat(key, F.lit(PATH), path).cast("binary").alias("at")


def _on_hosts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rid, path, own: for each URL the keys of its host and its parents that have rules."""
    nodes = rules.select("key").distinct()
    up = nodes.select("key", F.explode(_prefixes(F.col("key"))).alias("own"))
    held = up.join(nodes.withColumnRenamed("key", "own"), "own").groupBy("key").agg(F.collect_set(F.length("own")).alias("sizes"))  # labels at most
    starts = held.select("key", F.lit(0).alias("url"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("string").alias("path"), F.struct("key", "sizes").alias("open"))
    events = starts.unionByName(urls.select("key", F.lit(1).alias("url"), "rid", "path", F.lit(None).cast(starts.schema["open"].dataType).alias("open")))
    found = swept(events, ["key", "url", "rid"], "open", "url-hosts").filter("url = 1")
    owns = F.transform("open.sizes", lambda n: F.substring(F.col("open.key"), F.lit(1), n))
    return found.select("rid", "path", F.explode(F.filter(owns, lambda own: F.startswith("key", own))).alias("own"))


def _edges(rules: DataFrame) -> DataFrame:
    """at, url (0), rid, top: the starts and ends of the rules, with the rule that is open from there."""
    rule = F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"), F.concat("host", "path").alias("rule"), "verdict")
    starts = rules.select(_at(F.col("key"), F.col("path")), rule.alias("own"))
    after = F.concat("at", F.unhex(F.lit("FF")))  # a byte that no text has: behind all that the rule begins
    steps = starts.select("at", "own", F.lit(1).alias("step")).union(starts.select(after, "own", F.lit(-1).alias("step")))
    levels = running(steps, ["at"], {"level": "step"}, "url-depths").filter("step = 1")
    none = F.lit(None).cast(_RULE)
    rows = levels.select((F.col("level") + 1).alias("level"), "at", F.lit(0).alias("asks"), F.lit(None).cast(_RULE).alias("own"), F.col("own").alias("top"))
    rows = rows.union(levels.select("level", "at", F.lit(1).alias("asks"), "own", none.alias("top")))
    # no start has level 0, and all that ask there come first: they find none
    found = swept(rows, ["level", "at", "asks"], "top", "url-parents").filter("asks = 1")
    closed = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("len", "int"), ("host_len", "int"), ("rule", "string"), ("verdict", "string"))])
    edge = lambda at, top: found.select(at.alias("at"), F.lit(0).alias("url"), F.lit(None).cast("long").alias("rid"), top.alias("top"))
    return edge(F.col("at"), F.col("own")).unionByName(edge(after, F.coalesce("top", closed)))


def _prefixes(key: Column) -> Column:
    """The keys of a host and all its parents."""
    labels = F.split(key, END, -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), END), F.lit(END)))
