"""Vectors of texts through a cache, and of texts that are too long for the embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import snapshots as SN
from ..schema import Settings
from ..sources.store import Store


def embed_long(texts: DataFrame, embed, window: int = 256, overlap: int = 64) -> DataFrame:
    """(text, vector): the mean of the vectors of overlapping windows of words; short texts have one."""
    words = X.noop_tokens(F.col("text"))
    parts = texts.select("text").distinct().select("text", F.explode(V.token_windows(words, window, overlap)).alias("w"))
    each = parts.select("text", embed(F.array_join("w", " ")).alias("vector"))
    return V.mean_pool(each, ["text"], "vector").select("text", F.transform("vector", lambda x: x.cast("float")).alias("vector"))


def embed_cached(store: Store, texts: DataFrame, embed, model: str, settings: Settings | None = None, window: int = 256) -> DataFrame:
    """(text, vector) of every distinct text; known ones come from the cache, new ones go into it.

    Used rows are touched, and each model keeps at most ``cache_max_rows`` rows: the ones
    used longest ago go, a batch at a time.
    """
    s = settings or Settings()
    now = F.current_timestamp()
    cache = store.read("embedding_cache").withColumnRenamed("last_accessed_at", "last_accessed")
    wanted = texts.select("text").distinct().select(F.lit(model).alias("model"), F.unhex(F.sha2("text", 256)).alias("hash"), "text")
    looked = SN.cache_lookup(wanted, cache)
    missing = looked.filter("vector IS NULL").select("model", "hash", "text")
    made = store.work(missing.join(embed_long(missing, embed, window), "text").select("text", "model", "hash", "vector"))
    out = store.work(looked.filter("vector IS NOT NULL").select("text", "vector").unionAll(made.select("text", "vector")))
    new = made.select("model", "hash", "vector").withColumn("id", F.xxhash64("model", "hash"))
    touched = SN.touch(cache, looked.filter("vector IS NOT NULL"), now)
    full = SN.cache_store(touched, new, now)
    victims = SN.lru_victims(full, s.cache_max_rows, s.cache_trim_batch).select("id")
    store.write("embedding_cache", SN.delete(full, victims).withColumnRenamed("last_accessed", "last_accessed_at"))
    return out


def uncached(store: Store, texts: DataFrame, embed, model: str, settings: Settings | None = None) -> DataFrame:
    return embed_long(texts, embed)


#: Ways to keep vectors of texts between runs, by the name that ``Settings.embedding_cache`` has.
CACHES = {"store": embed_cached, "none": uncached}


def vectors_of(store: Store, texts: DataFrame, embed, model: str, settings: Settings | None = None) -> DataFrame:
    """(text, vector) of every distinct text, through the cache that the settings name."""
    s = settings or Settings()
    if s.embedding_cache not in CACHES:
        raise ValueError(f"no embedding cache {s.embedding_cache!r}: {sorted(CACHES)}")
    return CACHES[s.embedding_cache](store, texts, embed, model, s)
