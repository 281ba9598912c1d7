"""Text, URL and identity column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from marketloom.functions.scalar import col

# Lexicons, tier-one domains, tracking parameters, suffixes, classification rules.
POSITIVE = ("beat beats growth surge surges gain gains upgrade upgraded record strong bullish outperform expands expansion "
            "raises raised profit profitable partnership approval approved breakthrough").split()
NEGATIVE = ("miss misses decline declines drop drops downgrade downgraded weak bearish underperform cuts cut loss losses warning "
            "risk probe investigation lawsuit recall breach layoff layoffs bankruptcy default fraud delisting sanction sanctions").split()
TIER_ONE = ("reuters.com apnews.com bloomberg.com wsj.com ft.com cnbc.com nytimes.com washingtonpost.com economist.com "
            "barrons.com marketwatch.com").split()
TRACKING = r"(?i)^(utm_[^=]*|guccounter[^=]*|guce_referrer[^=]*|oc|ref|source)(=.*)?$"
MULTI_SUFFIX = ("co.uk", "com.au", "co.jp", "co.in", "com.cn", "com.sg")
RISK_RULES = [  # (severity, category, pattern), first match wins
    ("P1", "BANKRUPTCY", r"\b(bankrupt(?:cy)?|chapter\s*11|insolven(?:t|cy)|receivership)\b"),
    ("P1", "DELISTING", r"\b(delist(?:ed|ing)?|listing deficiency|noncompliance notice)\b"),
    ("P1", "DEFAULT", r"\b(debt default|defaulted on|covenant breach|payment default)\b"),
    ("P1", "FRAUD", r"\b(fraud|accounting irregularit|financial statements? should no longer be relied|restatement)\b"),
    ("P1", "ENFORCEMENT", r"\b(sec investigation|doj investigation|criminal investigation|indict(?:ed|ment))\b"),
    ("P1", "BUYBACK_STOP", r"\b(suspend(?:s|ed|ing)?|terminate(?:s|d|ing)?|cancel(?:s|led|ing)?)\b.{0,45}\b(share repurchase|stock buyback)\b"),
    ("P1", "CUSTOMER_LOSS", r"\b(loses? (?:a )?(?:major|key) customer|customer cancels?|contract termination|terminates? (?:the )?supply agreement)\b"),
    ("P2", "REGULATORY", r"\b(regulatory probe|regulatory investigation|antitrust probe|subpoena)\b"),
    ("P2", "SANCTIONS", r"\b(sanction(?:ed|s)?|export ban|export restriction|entity list)\b"),
    ("P2", "CYBER", r"\b(cyberattack|cyber attack|data breach|ransomware)\b"),
    ("P2", "RECALL", r"\b(product recall|safety recall|recalls? .* product)\b"),
    ("P2", "LITIGATION", r"\b(class action lawsuit|major lawsuit|patent infringement lawsuit)\b"),
    ("P2", "GUIDANCE", r"\b(profit warning|cuts? (?:its )?guidance|lowers? (?:its )?outlook|withdraws? guidance)\b"),
    ("P2", "LAYOFF", r"\b(mass layoffs?|workforce reduction|restructuring charges?)\b"),
    ("P2", "CAPACITY_CUT", r"\b(cuts? (?:production|output|capacity)|production halt|idles? (?:a )?(?:plant|factory|fab)|closes? (?:a )?(?:plant|factory|fab))\b"),
]
IMPACT_RULES = [  # (severity, category, direction, pattern)
    ("P2", "BUYBACK_AUTHORIZATION", "POSITIVE", r"\b(authoriz(?:e|es|ed|ing)|launch(?:es|ed|ing)|increase(?:s|d|ing)|expand(?:s|ed|ing)|resume(?:s|d|ing))\b.{0,55}\b(share repurchase|stock buyback|repurchase program)\b"),
    ("P3", "BUYBACK_ACTIVITY", "POSITIVE", r"\b(repurchase(?:d|s|ing)?|buy(?:s|ing|back))\b.{0,35}\b(shares?|common stock)\b"),
    ("P2", "CAPACITY_EXPANSION", "MIXED", r"\b(expand(?:s|ed|ing)? capacity|capacity expansion|new (?:plant|factory|fab)|opens? (?:a )?(?:plant|factory|fab)|production ramp|ramps? production)\b"),
    ("P2", "CAPACITY_REDUCTION", "NEGATIVE", r"\b(capacity reduction|cuts? (?:production|output|capacity)|delays? (?:a )?(?:plant|factory|fab|expansion)|idles? (?:a )?(?:plant|factory|fab))\b"),
    ("P2", "MAJOR_INVESTMENT", "MIXED", r"\b(invest(?:s|ed|ing|ment)?|capital expenditure|capex)\b.{0,55}\b(?:\$|usd\s*)?\d+(?:\.\d+)?\s*(?:billion|million|bn|mn)\b"),
    ("P2", "SUPPLY_AGREEMENT", "POSITIVE", r"\b(supply agreement|long[- ]term contract|multi[- ]year contract|strategic customer|design win|purchase commitment)\b"),
    ("P2", "INDUSTRY_PRICING", "MIXED", r"\b(price increase|price cut|pricing pressure|supply shortage|oversupply|inventory correction|demand recovery|demand slowdown)\b"),
]


# Literals of which a text must contain at least one (lower-cased) before a rule's pattern is tried.
NEEDLES = {
    "BANKRUPTCY": ["bankrupt", "chapter", "insolven", "receivership"], "DELISTING": ["delist", "listing deficiency", "noncompliance notice"],
    "DEFAULT": ["default", "covenant breach"], "FRAUD": ["fraud", "accounting irregularit", "no longer be relied", "restatement"],
    "ENFORCEMENT": ["investigation", "indict"], "BUYBACK_STOP": ["repurchase", "buyback"], "CUSTOMER_LOSS": ["customer", "contract termination", "supply agreement"],
    "REGULATORY": ["regulatory", "antitrust probe", "subpoena"], "SANCTIONS": ["sanction", "export", "entity list"], "CYBER": ["cyber", "data breach", "ransomware"],
    "RECALL": ["recall"], "LITIGATION": ["lawsuit"], "GUIDANCE": ["profit warning", "guidance", "outlook"], "LAYOFF": ["layoff", "workforce reduction", "restructuring charge"],
    "CAPACITY_CUT": ["production", "output", "capacity", "plant", "factory", "fab"], "BUYBACK_AUTHORIZATION": ["repurchase", "buyback"], "BUYBACK_ACTIVITY": ["share", "common stock"],
    "CAPACITY_EXPANSION": ["capacity", "plant", "factory", "fab", "production"], "CAPACITY_REDUCTION": ["capacity", "production", "output", "plant", "factory", "fab", "expansion"],
    "MAJOR_INVESTMENT": ["million", "billion", "bn", "mn"], "SUPPLY_AGREEMENT": ["supply agreement", "contract", "strategic customer", "design win", "purchase commitment"],
    "INDUSTRY_PRICING": ["price", "pricing", "supply", "inventory", "demand"]}


def normalize_ticker(c: Column | str) -> Column:
    t = F.upper(F.trim(col(c)))
    return F.when(t.rlike(r"^[A-Z][A-Z0-9.\-]{0,14}$"), t)


def normalize_cik(c: Column | str) -> Column:
    digits = F.regexp_replace(col(c), r"\D", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def valid_http_url(c: Column | str) -> Column:
    u = F.trim(col(c))
    return F.when(u.rlike(r"^(?i)https?://[^\s/?#]+"), u)


def canonical_url(c: Column | str) -> Column:
    """Drop the fragment and tracking parameters, keep the rest of the query in order."""
    u = F.regexp_replace(F.trim(col(c)), r"#.*$", "")
    base, query = F.substring_index(u, "?", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING)), "&")
    return F.when(F.instr(u, "?") == 0, u).when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def registrable_domain(c: Column | str) -> Column:
    host = F.lower(F.regexp_extract(col(c), r"^(?i)https?://(?:www\.)?([^/:?#]+)", 1))
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last2 = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    last3 = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(host == "", None).when(n <= 2, host).when(last2.isin(*MULTI_SUFFIX), last3).otherwise(last2)


def story_text(title: Column | str) -> Column:
    """Lower-cased title without a trailing " - Publisher", letters, digits and CJK only."""
    t = F.regexp_replace(F.lower(col(title)), r"\s+-\s+[^-]{2,60}$", "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def story_fingerprint(title: Column | str) -> Column:
    return F.sha2(story_text(title), 256)


def content_key(*parts: Column) -> Column:
    """sha256 over the ordered parts."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([a-z][a-z'\-]*)"), F.lit(1))


def text_sentiment(c: Column | str) -> Column:
    """(positive - negative) / max(2, hits) over lexicon words, within -1..1; 0 without hits.

    One fold over the words counts both lexicons, so the text is scanned once.
    """
    one = lambda hit: F.when(hit, 1).otherwise(0)
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))
    step = lambda a, w: F.struct((a["p"] + one(w.isin(*POSITIVE))).alias("p"), (a["n"] + one(w.isin(*NEGATIVE))).alias("n"))
    finish = lambda a: F.when(a["p"] + a["n"] == 0, 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a["p"] - a["n"]) / F.greatest(F.lit(2), a["p"] + a["n"]))))
    return F.aggregate(words(c), zero, step, finish)


def sentiment_label(c: Column | str) -> Column:
    s = col(c)
    return (F.when(s >= 0.35, "Bullish").when(s <= -0.35, "Bearish").when(s > 0, "Somewhat-Bullish")
            .when(s < 0, "Somewhat-Bearish").otherwise("Neutral"))


def source_tier(domain: Column | str, kind: Column | str) -> Column:
    d = F.lower(F.coalesce(col(domain), F.lit("")))
    top = d.rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in TIER_ONE) + ")$")
    return F.when(col(kind) == "DISCUSSION", "SOCIAL").when(top, "TIER_1").otherwise("TIER_2")


def relevance(text: Column | str, ticker: Column | str, name: Column | str) -> Column:
    t, k, n = F.lower(col(text)), F.lower(col(ticker)), F.lower(col(name))
    return (F.when(F.contains(t, F.concat(F.lit("$"), k)), 1.0).when((n != "") & F.contains(t, n), 0.95)
            .when(F.regexp_like(t, F.concat(F.lit(r"\b"), k, F.lit(r"\b"))), 0.72).otherwise(0.0))


def first_rule(text: Column | str, rules: list[tuple], guards: list[Column | None] | None = None) -> Column:
    """Position of the first matching rule (0-based), null if none; patterns are tried in order."""
    t = col(text)

    def tried(low: Column) -> Column:
        arms = []
        for i, rule in enumerate(rules):
            hit = F.contains(low, F.lit(NEEDLES[rule[1]][0]))
            for needle in NEEDLES[rule[1]][1:]:
                hit = hit | F.contains(low, F.lit(needle))
            hit = hit & t.rlike("(?i)" + rule[-1])
            guard = guards[i] if guards else None
            arms.append(F.when(hit if guard is None else guard & hit, F.lit(i)))
        return F.coalesce(*arms)

    return _bound(F.lower(t), tried)


def _bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable."""
    return F.transform(F.array(value), use)[0]


def _pick(rules: list[tuple], i: Column, field: int) -> Column:
    return F.get(F.array(*[F.lit(rule[field]) for rule in rules]), i)


def _term(text: Column | str, rules: list[tuple], i: Column) -> Column:
    return F.coalesce(*[F.when(i == k, F.regexp_extract(col(text), "(?i)" + rule[-1], 0)) for k, rule in enumerate(rules)])


def classify_risk(text: Column | str, sentiment: Column | str, rel: Column | str, kind: Column | str) -> Column:
    """News risk: severe rules need a sentiment that is not positive; discussions are downgraded."""
    s, r = col(sentiment), col(rel)
    low = s.isNull() | (s <= 0.05)
    first = first_rule(text, RISK_RULES, [low if rule[0] == "P1" else None for rule in RISK_RULES])

    def build(i: Column) -> Column:
        sev, cat = _pick(RISK_RULES, i, 0), _pick(RISK_RULES, i, 1)
        social = (col(kind) == "DISCUSSION") & (sev == "P1")
        return (F.when(i.isNotNull(), F.struct(F.when(social, "P2").otherwise(sev).alias("severity"),
                                               F.when(social, F.concat(F.lit("SOCIAL_"), cat)).otherwise(cat).alias("category"), _term(text, RISK_RULES, i).alias("term")))
                .when((s <= -0.5) & (r >= 0.7), F.struct(F.lit("P2").alias("severity"), F.lit("NEGATIVE_SENTIMENT").alias("category"), F.lit(None).cast("string").alias("term"))))

    return F.when(r >= 0.35, _bound(first, build))


def classify_impact(text: Column | str, rel: Column | str, kind: Column | str) -> Column:
    def build(i: Column) -> Column:
        sev = _pick(IMPACT_RULES, i, 0)
        down = F.when((col(kind) == "DISCUSSION") & (sev == "P2"), "P3").otherwise(sev)
        return F.when(i.isNotNull(), F.struct(down.alias("severity"), _pick(IMPACT_RULES, i, 1).alias("category"), _pick(IMPACT_RULES, i, 2).alias("direction"), _term(text, IMPACT_RULES, i).alias("term")))

    return F.when(col(rel) >= 0.4, _bound(first_rule(text, IMPACT_RULES), build))


def decode_entities(c: Column | str) -> Column:
    """CDATA sections and the named and numeric entities of feed text; & is decoded last."""
    t = F.regexp_replace(col(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    t = F.replace(t, F.lit("&#160;"), F.lit(" "))
    references = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});)"), F.lit(1)))
    t = F.when(F.contains(t, F.lit("&#")), F.aggregate(references, t, lambda text, ref: F.replace(text, ref, _character(ref)))).otherwise(t)
    for src, dst in (("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(src), F.lit(dst))
    return t


def _character(ref: Column) -> Column:
    """The character of a numeric reference; one that names no character stays as it is."""
    hexadecimal = F.lower(F.substring(ref, 3, 1)) == "x"
    point = F.when(hexadecimal, F.conv(F.regexp_extract(ref, r"([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(ref, r"([0-9]+);$", 1)).cast("long")
    real = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(ref)


def yahoo_symbol(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("."), F.lit("-"))


def filing_url(cik: Column | str, accession: Column | str, document: Column | str) -> Column:
    root = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), col(cik).cast("long").cast("string"), F.lit("/"), F.replace(col(accession), F.lit("-"), F.lit("")), F.lit("/"))
    return F.when(col(document).isNull(), F.concat(root, col(accession), F.lit("-index.html"))).otherwise(F.concat(root, F.url_encode(col(document))))


def trade_side(c: Column | str) -> Column:
    """BUY / SELL from the accepted import words."""
    t = F.upper(F.trim(col(c)))
    return F.when(t.isin("BUY", "B", "买入", "买"), "BUY").when(t.isin("SELL", "S", "卖出", "卖"), "SELL")


def import_number(c: Column | str) -> Column:
    """A number that may carry thousands separators or a currency sign."""
    return F.regexp_replace(F.trim(col(c)), r"[,$\s]", "").try_cast("double")
