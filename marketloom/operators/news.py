"""News: story identity, de-duplication, classification, sentiment and event rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def earlier_match(items: DataFrame, item_id: str, url_key: list[str], story_key: str, date: str, days: int) -> DataFrame:
    """The earliest earlier item that is the same (by URL key, else by story within ``days``).

    Only per-key and per-(story, day) minima are compared, so a story copied millions of times
    costs one aggregate, never its pairs.
    """
    first_url = items.groupBy(*url_key).agg(F.min(item_id).alias("_u"))
    per_day = items.groupBy(story_key, date).agg(F.min(item_id).alias("_m"))
    near = per_day.select(story_key, F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_o"), date, "_m")
    near = near.select(story_key, F.date_add(date, F.col("_o")).alias(date), "_m").groupBy(story_key, date).agg(F.min("_m").alias("_s"))
    j = items.join(first_url, url_key).join(near, [story_key, date])
    same_url, same_story = F.col("_u") < F.col(item_id), F.col("_s") < F.col(item_id)
    return (j.where(same_url | same_story)
            .select(item_id, F.when(same_url, F.col("_u")).otherwise(F.col("_s")).alias("matched_id"),
                    F.when(same_url, "SAME_URL").otherwise("SAME_STORY").alias("rule")))


def deduplicate_stories(articles: DataFrame, gap_days: int = 2) -> DataFrame:
    """One row per story: the same canonical URL, else the same fingerprint with gaps of at most
    ``gap_days`` between publication days; attributes merged (best tier, NEWS wins, most engagement,
    first non-null summary).

    Articles are reduced per URL first, then per (fingerprint, day); only those days are scanned
    for gaps, so a story with millions of copies is one aggregate.
    """
    merged = [F.max((F.col("source_tier") == "TIER_1").cast("int")).alias("tier1"), F.max((F.col("content_kind") == "NEWS").cast("int")).alias("news"),
              F.max("engagement").alias("engagement"), F.min("article_id").alias("article_id"), F.count("*").alias("copies")]
    by_url = articles.groupBy("canonical_url").agg(*merged, F.min_by("fingerprint", F.struct("published_on", "article_id")).alias("fingerprint"), F.min("published_on").alias("published_on"))
    per_day = by_url.groupBy("fingerprint", "published_on").agg(
        F.max("tier1").alias("tier1"), F.max("news").alias("news"), F.max("engagement").alias("engagement"), F.min("article_id").alias("article_id"), F.sum("copies").alias("copies"))
    w = Window.partitionBy("fingerprint").orderBy("published_on")
    starts = F.coalesce(F.datediff("published_on", F.lag("published_on").over(w)) > gap_days, F.lit(True))
    d = per_day.withColumn("_start", starts.cast("int"))
    d = d.withColumn("story_no", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("fingerprint", "story_no").agg(
        F.min("article_id").alias("article_id"), F.min("published_on").alias("first_published"), F.max("published_on").alias("last_published"),
        F.when(F.max("tier1") == 1, "TIER_1").otherwise("TIER_2").alias("source_tier"), F.when(F.max("news") == 1, "NEWS").otherwise("DISCUSSION").alias("content_kind"),
        F.max("engagement").alias("engagement"), F.sum("copies").alias("copies"))


def corroboration(articles: DataFrame, key: str, days: int = 2) -> DataFrame:
    """Distinct publishers of a story within +-days of each publication day, and the corroborated flag."""
    seen = articles.select(key, "published_on", "publisher", "source_tier").distinct()
    near = seen.withColumn("_o", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("_day", F.date_add("published_on", F.col("_o")))
    around = near.groupBy(key, F.col("_day").alias("published_on")).agg(F.countDistinct("publisher").alias("publishers"), F.max((F.col("source_tier") == "TIER_1").cast("int")).alias("_t"),
                                                                      F.bool_or(F.col("_o") == 0).alias("_own"))
    j = around.where(F.col("_own") & F.col(key).isNotNull() & F.col("published_on").isNotNull())  # days of the story itself
    return j.select(key, "published_on", "publishers", ((F.col("publishers") >= 2) | (F.col("_t") == 1)).alias("corroborated"))


def sentiment_summary(articles: DataFrame, as_of: Column) -> DataFrame:
    """Trailing week totals, last day against the day before, negative share and trend per ticker."""
    age = F.datediff(as_of, F.col("published_on"))
    a = articles.where((age >= 0) & (age < 7)).withColumn("_age", age)
    s = F.col("sentiment")
    g = a.groupBy("ticker").agg(
        F.count("*").alias("articles_7d"), F.avg("sentiment").alias("mean_sentiment"), F.count_if(F.col("_age") == 0).alias("articles_1d"), F.count_if(F.col("_age") == 1).alias("articles_prev_1d"),
        F.avg(F.when(F.col("_age") == 0, s)).alias("_s1"), F.avg(F.when(F.col("_age") == 1, s)).alias("_s0"), F.avg((s < 0).cast("double")).alias("negative_ratio"))
    delta = F.col("_s1") - F.col("_s0")
    return g.withColumn("trend", F.when(delta.isNull(), "INSUFFICIENT").when(delta >= 0.1, "IMPROVING").when(delta <= -0.1, "DETERIORATING").otherwise("STABLE")).drop("_s1", "_s0")


def news_events(articles: DataFrame, risk: str = "risk", impact: str = "impact") -> DataFrame:
    """Event rows with stable keys from classified articles."""
    base = ["article_id", "ticker", "published_on"]
    # explode of a compacted one-element array evaluates the classification once and drops nulls
    one = lambda c: articles.select(*base, F.explode(F.array_compact(F.array(F.col(c)))).alias("x"))
    r = one(risk).select(*base, F.lit("NEWS_RISK").alias("source_type"), "x.severity", "x.category",
                         F.concat_ws(":", F.lit("NEWS_RISK"), F.col("article_id").cast("string"), "ticker").alias("event_key"))
    i = one(impact).select(*base, F.lit("NEWS_IMPACT").alias("source_type"), "x.severity", "x.category",
                           F.concat_ws(":", F.lit("NEWS_IMPACT"), F.col("article_id").cast("string"), "ticker", "x.category").alias("event_key"))
    return r.unionByName(i)


def combine_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of provider frames, each row tagged with its source."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("feed", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
