"""URL filters by a temporal join with dated lists.

List events (add, remove) of a key become validity intervals.  A capture is looked up
under every parent domain of its host and every leading run of its path that a list
could name, and an entry counts if it was active at the capture's fetch time.  The
as-of join has two steps: a key's row tells which part of its history holds the fetch
time, and that part, of bounded length, tells whether the key was active.  Both joins
meet one row a key on the lists' side, so a key that a third of all captures asks for
can be split over tasks.  All of it is DataFrame operations; pages' texts are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, let, materialize

DAY = 86400
#: Intervals in one part of a key's history.
PART = 256
#: 2024 from its first second on: the time of the query's captures and list events.
START, SECONDS = 1704067200, 366 * DAY
#: Of the hosts, sites (last three labels) and first path segments of ``pages`` one in so many is listed.
LISTED = {"host": 5, "domain": 7, "prefix": 4}
#: Events of a listed key at most, and of a domain of two labels.
EVENTS, HISTORY = 6, 200


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; empty if there is none."""
    return F.regexp_replace(ascii_lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """(kind, key, since, until): when each entry is active; ``until`` is null while it stays.

    ``events`` has kind (domain, host, prefix), pattern, action and ``at`` in seconds.
    Of events of one key and time a removal comes last; a removal of what isn't listed
    does nothing; an entry added twice stays until the next removal.  Events with a
    null are passed over.
    """
    known = events.filter("kind IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select("kind", ascii_lower(F.col("pattern")).alias("key"), "action", "at")
    each = known.groupBy("kind", "key", "at").agg(F.max("action").alias("action"))
    turn = Window.partitionBy("kind", "key").orderBy("at")
    changed = each.withColumn("was", F.lag("action").over(turn)).filter("was IS NULL OR was <> action")
    return changed.withColumn("until", F.lead("at").over(turn)).filter("action = 'add'").select("kind", "key", F.col("at").alias("since"), "until")


def histories(events: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Two tables of each (kind, key): the first times of its parts, and a row a part with its intervals."""
    turn = Window.partitionBy("kind", "key").orderBy("since")
    cut = intervals(events).withColumn("part", F.floor((F.row_number().over(turn) - 1) / part).cast("int"))
    parts = cut.groupBy("kind", "key", "part").agg(F.collect_list(F.struct("since", "until")).alias("spans"), F.min("since").alias("first"))
    parts = materialize(parts, "parts")
    return parts.groupBy("kind", "key").agg(F.sort_array(F.collect_list("first")).alias("firsts")), parts.select("kind", "key", "part", "spans")


def keys_of(host: Column, path: Column, labels: int, segments: int) -> Column:
    """The (kind, key) under which a list may name a URL: domains of up to ``labels`` labels, prefixes of up to ``segments``."""
    domain = lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(x, i, F.size(x)), ".").alias("key")))
    last = lambda x: F.slice(x, F.greatest(F.size(x) - labels + 1, F.lit(1)), labels)
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    nothing = F.slice(whole, 1, 0)
    domains = let(last(F.split(host, r"\.")), domain) if labels else nothing
    bare = F.concat(F.regexp_replace(host, r"^www\.", ""), F.lit("/"))
    run = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(bare, F.array_join(F.slice(x, 1, i), "/")).alias("key")))
    steps = F.slice(F.filter(F.split(ascii_lower(path), "/"), lambda x: x != ""), 1, max(segments, 1))
    runs = let(steps, lambda x: F.when(F.size(x) > 0, run(x)).otherwise(nothing)) if segments else nothing
    return F.when(host != "", F.concat(whole, domains, runs)).otherwise(nothing)


def apply_lists(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched_at", part: int = PART) -> DataFrame:
    """``captures`` with ``host``, ``n_rules``, ``rules`` (kind:key, sorted, joined by a space) and ``blocked``.

    ``time_col`` is in seconds.  A capture with a null URL, no host or no fetch time
    meets no rule.  Every row gives one row, repeated rows too; the new columns replace
    any of their names.  A URL costs no more look-ups than the lists' longest entries
    have labels and segments, however long it is.
    """
    added = ("host", "n_rules", "rules", "blocked")
    keep = [c for c in captures.columns if c not in added]
    rows = captures.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_c"), host_of(F.coalesce(url_col, F.lit(""))).alias("host"), path_of(F.coalesce(url_col, F.lit(""))).alias("_path"), F.col(time_col).cast("long").alias("_t"))
    rows = materialize(rows, "captures")
    firsts, parts = histories(events, part)
    most = lambda kind, sign: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("key", sign)))), F.lit(0))
    longest = firsts.agg(most("domain", r"\.").alias("labels"), (most("prefix", "/") - 1).alias("segments")).first()
    asked = rows.filter("_t IS NOT NULL").select("_row", "_t", F.explode(keys_of(F.col("host"), F.col("_path"), longest["labels"], max(0, longest["segments"]))).alias("k")).select("_row", "_t", "k.*")
    found = asked.join(firsts, ["kind", "key"]).withColumn("part", F.size(F.filter("firsts", lambda x: x <= F.col("_t"))) - 1).filter("part >= 0").drop("firsts")
    active = F.exists("spans", lambda x: (x["since"] <= F.col("_t")) & (x["until"].isNull() | (F.col("_t") < x["until"])))
    met = found.join(parts, ["kind", "key", "part"]).filter(active)
    rules = met.groupBy("_row").agg(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "key"))).alias("r"))
    out = rows.join(rules, "_row", "left").withColumn("n", F.coalesce(F.size("r"), F.lit(0)).cast("long"))
    return out.select("_c.*", "host", F.when(F.col("r").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_rules"), F.coalesce(F.array_join("r", " "), F.lit("")).alias("rules"), F.col("r").isNotNull().alias("blocked"))


def _number(text: Column) -> Column:
    """32 bits of a text, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dated(pages: DataFrame) -> DataFrame:
    """Captures of the ``pages`` table, spread over 2024 by their ids (the table has no times)."""
    return pages.select("page_id", "url", (F.lit(START) + _number(F.concat(F.lit("page:"), F.col("page_id").cast("string"))) % SECONDS).alias("fetched_at"))


def list_events(pages: DataFrame) -> DataFrame:
    """(kind, pattern, action, at): lists drawn from the hosts and paths of ``pages``.

    By hash, one in ``LISTED`` of the hosts, sites and first path segments is listed, and
    every domain of two labels, with up to ``EVENTS`` or exactly ``HISTORY`` additions and
    removals at times of 2024 that the hash gives.
    """
    url = F.coalesce("url", F.lit(""))
    at = pages.select(host_of(url).alias("host"), F.element_at(F.concat(F.filter(F.split(ascii_lower(path_of(url)), "/"), lambda x: x != ""), F.array(F.lit(""))), 1).alias("step")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    site = lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), "."))
    prefix = F.when(F.col("step") != "", F.concat(F.regexp_replace("host", r"^www\.", ""), F.lit("/"), "step"))
    kinds = [("host", F.col("host")), ("domain", site(3)), ("domain", site(2)), ("prefix", prefix)]
    named = at.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key.alias("pattern")) for k, key in kinds])).alias("k")).select("k.*").filter("pattern IS NOT NULL").distinct()
    number = _number(F.concat_ws(":", "kind", "pattern"))
    broad = (F.col("kind") == "domain") & (F.size(F.split("pattern", r"\.")) == 2)
    one_in = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in LISTED.items()])
    listed = named.filter(broad | (number % one_in == 0)).withColumn("n", F.when(broad, HISTORY).otherwise(1 + (number / 1000).cast("long") % EVENTS))
    event = listed.select("kind", "pattern", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    when = F.lit(START) + _number(F.concat_ws(":", "kind", "pattern", F.col("i").cast("string"))) % SECONDS
    return event.select("kind", "pattern", F.when(F.col("i") % 2 == 1, "add").otherwise("remove").alias("action"), when.alias("at"))


_NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"
#: The last event of a key up to the fetch time tells whether it is active; a removal comes after an addition of its time.
ORACLE_SQL = rf"""
WITH c AS (SELECT row_number() OVER () AS rid, page_id, url, {START} + {_NUMBER.format("'page:' || page_id")} % {SECONDS} AS fetched_at,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
    list_filter(string_split(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1)), '/'), lambda x: x <> '') AS steps FROM pages),
p AS (SELECT *, string_split(host, '.') AS labels, regexp_replace(host, '^www\.', '') AS bare FROM c WHERE host <> ''),
named AS (SELECT 'host' AS kind, host AS key FROM p
    UNION SELECT 'domain', array_to_string(labels[-3:], '.') FROM p WHERE len(labels) >= 3
    UNION SELECT 'domain', array_to_string(labels[-2:], '.') FROM p WHERE len(labels) >= 2
    UNION SELECT 'prefix', bare || '/' || steps[1] FROM p WHERE len(steps) > 0),
rated AS (SELECT kind, key, {_NUMBER.format("kind || ':' || key")} AS num, kind = 'domain' AND len(string_split(key, '.')) = 2 AS broad FROM named),
listed AS (SELECT kind, key, CASE WHEN broad THEN {HISTORY} ELSE 1 + num // 1000 % {EVENTS} END AS n FROM rated
    WHERE broad OR num % CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in LISTED.items())} END = 0),
ev AS (SELECT kind, key, CASE WHEN i % 2 = 1 THEN 'add' ELSE 'remove' END AS action, {START} + {_NUMBER.format("kind || ':' || key || ':' || i")} % {SECONDS} AS ts
    FROM (SELECT kind, key, unnest(range(1, n + 1)) AS i FROM listed)),
asked AS (SELECT rid, fetched_at, 'host' AS kind, host AS key FROM p
    UNION ALL SELECT rid, fetched_at, 'domain', array_to_string(labels[i:], '.') FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM p)
    UNION ALL SELECT rid, fetched_at, 'prefix', bare || '/' || array_to_string(steps[1:i], '/') FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM p)),
m AS (SELECT rid, kind || ':' || key AS rule FROM asked JOIN ev USING (kind, key) WHERE ts <= fetched_at GROUP BY rid, kind, key HAVING max(ts * 2 + (action = 'remove')::BIGINT) % 2 = 0)
SELECT page_id, url, fetched_at, host, count(rule) AS n_rules, coalesce(string_agg(rule, ' ' ORDER BY rule), '') AS rules, count(rule) > 0 AS blocked
FROM c LEFT JOIN m USING (rid) GROUP BY rid, page_id, url, fetched_at, host
"""
