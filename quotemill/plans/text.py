"""News and documents: mentions, sentiment, relevance and weight, daily signals, document classes, page fields."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.functions.rules import normal_url, rounded
from quotemill.operators.batches import small
from quotemill.operators.keyed import once, ranked_dedupe, top_per_group
from quotemill.plans.pages import _let, absolute_url, all_texts, best_body, one_text, select, text_of, with_elements

ZONE = "Asia/Ho_Chi_Minh"
#: Keywords of the sentiment count; nested ones count twice.
POSITIVE = ("tăng", "vượt", "lãi", "lợi nhuận", "kỷ lục", "tích cực", "phục hồi", "khả quan")
NEGATIVE = ("giảm", "lỗ", "lao dốc", "sụt giảm", "áp lực", "cảnh báo", "tiêu cực", "thua lỗ")
#: Accented letters by base letter; the stroked d is handled by each function.
_ACCENTS = {
    "a": "àáạảãâầấậẩẫăằắặẳẵ", "e": "èéẹẻẽêềếệểễ", "i": "ìíịỉĩ", "o": "òóọỏõôồốộổỗơờớợởỡ", "u": "ùúụủũưừứựửữ", "y": "ỳýỵỷỹ", "n": "ñ", "c": "ç",
}
_FROM = "".join(_ACCENTS.values())
_TO = "".join(base * len(marked) for base, marked in _ACCENTS.items())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_accents(x) -> Column:
    """Upper case without accents, letter by letter so that positions stay; the stroked D stays as it is."""
    return F.translate(F.upper(_c(x)), _FROM.upper(), _TO.upper())


def plain(x) -> Column:
    """Lower case without accents, the stroked d as d."""
    return F.translate(F.lower(_c(x)), _FROM + "đ", _TO + "d")


def normal_title(x) -> Column:
    return F.trim(F.regexp_replace(plain(x), "[^a-z0-9]+", " "))


def keyword_pattern(words) -> str:
    """A pattern that captures, at every place of a text, the longest of the words that begins there: a tree of their letters, so that all words are
    looked for in one pass, those inside others as well."""
    tree: dict = {}
    for w in words:
        node = tree
        for letter in w:
            node = node.setdefault(letter, {})
        node[""] = {}

    def branch(node: dict) -> str:
        parts = [re.escape(letter) + branch(below) for letter, below in sorted(node.items()) if letter]
        if not parts:
            return ""
        inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{inner})?+" if "" in node else inner

    first = "".join(re.escape(letter) for letter in sorted(tree))
    return f"(?=[{first}])(?=({branch(tree)}))"


def keyword_hits(text: Column, words) -> Column:
    """The words that occur in a text, in order, each as often as it occurs; of words that begin at one place the longest."""
    return F.regexp_extract_all(text, F.lit(keyword_pattern(words)), F.lit(1))


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of all occurrences of the words; a word that begins another one counts with it."""
    whole = {w: sum(weight for other, weight in weights.items() if w.startswith(other)) for w in weights}
    of = F.create_map(*(F.lit(x) for pair in whole.items() for x in pair))
    return F.aggregate(keyword_hits(text, weights), F.lit(0), lambda total, w: total + F.coalesce(F.try_element_at(of, w), F.lit(0)))


def sentiment(text) -> Column:
    """Positive minus negative keyword counts."""
    return keyword_score(F.lower(_c(text)), dict.fromkeys(POSITIVE, 1) | dict.fromkeys(NEGATIVE, -1))


def label(score: Column) -> Column:
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def word_count(*parts) -> Column:
    return F.regexp_count(F.concat_ws(" ", *parts), F.lit(r"[^ \t\n\r\f\x0b]+"))


def all_tickers() -> Column:
    """The given ticker and the mentions, trimmed, without blanks or repeats."""
    own = F.when(F.trim(F.coalesce("ticker", F.lit(""))) != "", F.array(F.trim("ticker"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(own, F.coalesce("ticker_mentions", F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def primary_ticker() -> Column:
    """The given ticker if it is among the mentions, else the first mention."""
    m = F.coalesce("ticker_mentions", F.array().cast("array<string>"))
    return F.when(F.array_contains(m, F.coalesce("ticker", F.lit(""))), F.col("ticker")).otherwise(F.get(m, F.lit(0)))


#: Parts of a source's name and the tier they give.
TIERS = (("src1", 1), ("src2", 2))


def article_codes(news: DataFrame, tiers: tuple[tuple[str, int], ...] = TIERS) -> DataFrame:
    """One row per row of ``news`` and ticker with relevance (where the code stands) and the source's tier."""
    n = news.where("published_date is not null and article_id is not null and trim(coalesce(title, '')) <> ''").withColumn("code", F.explode(all_tickers()))
    within = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower("code"))
    tier = F.lit(3)
    for name, k in reversed(tiers):
        tier = F.when(F.col("source").ilike(f"%{name}%"), k).otherwise(tier)
    return n.withColumns({"ticker_relevance": F.when(within("title"), "title").when(within("summary"), "summary").otherwise("body"), "source_tier": tier}).drop("ticker").withColumnRenamed("code", "ticker")


def article_order() -> list[Column]:
    """Of the rows of one article and ticker the least counts."""
    rank = F.when(F.col("ticker_relevance") == "title", 1).when(F.col("ticker_relevance") == "summary", 2).otherwise(3)
    return [rank.alias("rank"), F.col("source"), F.col("doc_id")]


def article_tickers(news: DataFrame, tiers: tuple[tuple[str, int], ...] = TIERS) -> DataFrame:
    """One row per article and ticker with relevance (where the code stands) and the source's tier."""
    return ranked_dedupe(article_codes(news, tiers), ["article_id", "ticker"], article_order())


def local_time(x) -> Column:
    return F.from_utc_timestamp(x, ZONE)


def local_day() -> Column:
    return F.coalesce(F.to_date(local_time("published_at")), F.col("published_date"))


def session_day() -> Column:
    """The session an article belongs to: weekends move to Monday, what comes after 14:30 to the next day."""
    t = local_time("published_at")
    late = F.date_format(t, "HH:mm:ss.SSSSSS") > "14:30:00.000000"
    return F.when(F.dayofweek(t) == 1, F.date_add("published_date", 1)).when(F.dayofweek(t) == 7, F.date_add("published_date", 2)).when(late, F.date_add("published_date", 1)).otherwise(F.col("published_date"))


def article_weight(as_of) -> Column:
    """Relevance times tier times decay by age (48 hours to 1/e)."""
    relevance = F.when(F.col("ticker_relevance") == "title", 3.0).when(F.col("ticker_relevance") == "summary", 2.0).otherwise(1.0)
    tier = F.when(F.col("source_tier") == 1, 1.5).when(F.col("source_tier") == 2, 1.2).otherwise(1.0)
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("published_at")
    return relevance * tier * F.coalesce(F.exp(-age / (48.0 * 3600.0)), F.lit(1.0))


def weighted_articles(facts: DataFrame, as_of) -> DataFrame:
    return facts.where("url is not null and title is not null").withColumns({"trading_date": session_day(), "article_weight": article_weight(as_of)})


def news_signal(weighted: DataFrame, top: int = 3) -> DataFrame:
    """Per ticker and session: counts, weighted and plain mean, signal, majority, and the heaviest articles as JSON."""
    score, w = F.col("sentiment_score"), F.col("article_weight")
    mean = F.sum(score * w) / F.when(F.sum(w) != 0, F.sum(w))
    n = lambda x: F.count_if(F.col("sentiment_label") == x)
    keys = ["ticker", "trading_date"]
    sums = weighted.groupBy(*keys).agg(
        F.count("*").alias("news_count"), n("positive").alias("positive_count"), n("negative").alias("negative_count"), n("neutral").alias("neutral_count"), rounded(mean, 4).alias("weighted_sentiment"), rounded(F.avg(score), 4).alias("avg_sentiment_score"),
        F.when(mean >= 0.3, "buy_signal").when(mean <= -0.3, "sell_signal").otherwise("neutral").alias("news_signal"), F.when(n("positive") > n("negative"), "positive").when(n("negative") > n("positive"), "negative").otherwise("neutral").alias("dominant_sentiment"),
    )
    best = top_per_group(weighted, keys, [F.desc_nulls_last("article_weight"), F.asc("article_id")], top)
    item = F.struct("rank", "article_id", "title", "url", F.col("sentiment_label").alias("sentiment"), "published_at", F.col("ticker_relevance").alias("relevance"), rounded("article_weight", 4).alias("weight"))
    lists = best.groupBy(*keys).agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("rank")), {"ignoreNullFields": "false"}).alias("top_articles"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"])).alias("top_ids"))
    return sums.join(lists, keys, "left")


def sentiment_daily(facts: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("sentiment_label") == x)
    return facts.groupBy("ticker", "published_date").agg(F.count("*").alias("news_count"), rounded(F.avg("sentiment_score"), 4).alias("avg_score"), n("positive").alias("positive_count"), n("negative").alias("negative_count"), n("neutral").alias("neutral_count"), F.mode("sentiment_label", True).alias("dominant_label"))


def stock_daily(prices: DataFrame, signal: DataFrame) -> DataFrame:
    """The whole rows of prices with what the signal says of their day."""
    columns = ("news_count", "avg_sentiment_score", "weighted_sentiment", "dominant_sentiment", "news_signal", "top_articles", "top_ids")
    s = signal.select("ticker", "trading_date", *(c for c in columns if c in signal.columns))
    return prices.join(s, ["ticker", "trading_date"], "left").withColumn("news_count", F.coalesce("news_count", F.lit(0)))


# --- mentions

#: Codes that are also words, and context rules (pattern at the end of the left side or the start of the right, points, whether the
#: token must be in capitals).
BLOCKED = ("CEO", "HCM", "LAI", "NHA", "THU", "TIN", "TOP", "TRA", "USD", "VUA", "VND")
LEFT_RULES = [(r"\b(HOSE|HNX|UPCOM|UPCOMINDEX|HSX)\s*:?\s*$", 110, False), (r"\b(MCK|MA\s+CK|MA\s+CHUNG\s+KHOAN)\s*:?\s*$", 105, False), (r"\bMA\s*:?\s*$", 95, True), (r"\b(CP|CO\s+PHIEU|CHUNG\s+KHOAN)\s+$", 85, True)]
#: Contexts in which a blocked code is a plain word, one entry a rule.
VETOES = {
    "HCM": [r"\bTP\s*\.?\s*HCM\b", r"\bTPHCM\b", r"\bHO\s+CHI\s+MINH\b", r"\bTHANH\s+PHO\s+HO\s+CHI\s+MINH\b"],
    "LAI": [r"\bGIA\s+LAI\b", r"\bLAI\s+(?:SUAT|RONG|VAY|TIEN|SAU|TRUOC|LON|GOP|KEP)\b", r"\bCO\s+LAI\b"],
    "NHA": [r"\bNHA\s+(?:NUOC|DAU\s+TU|TY\s+PHU|DAT|O|MAY|XUONG|BANG)\b", r"\bUY\s+BAN\s+CHUNG\s+KHOAN\s+NHA\s+NUOC\b"],
    "THU": [r"\bTHU\s+\d+\b", r"\b(?:DOANH|LOI|NGUON|KHOAN|TIEN|THUE)\s+THU\b", r"\bTHU\s+(?:NHAP|HUT|HOI|PHI|VE|DUOC|TU|NGAN|NGHIEM)\b", r"\bHA\s+THU\b"],
    "TIN": [r"\bTIN\s+(?:TUC|MOI|DON|HIEU|VUI|XAU|TICH\s+CUC|TIEU\s+CUC)\b", r"\bBAN\s+TIN\b"],
    "TOP": [r"\bTOP\s+\d+\b", r"\bTOP\s+(?:CO\s+PHIEU|DOANH\s+NGHIEP|NGANH|DAU)\b"],
    "TRA": [r"\bTRA\s+(?:CO\s+TUC|LAI|NO|TIEN|PHI|LUONG)\b", r"\b(?:CHI|HOAN|DUOC|PHAI|SE)\s+TRA\b"],
    "USD": [r"\bTY\s+GIA\s+USD\b", r"[\d.,]+\s*(?:TY|TRIEU|NGHIN)?\s+USD\b", r"\b(?:TY|TRIEU|NGHIN)\s+USD\b", r"\bUSD\s*/\s*VND\b", r"\bUSD\s+(?:TANG|GIAM|MANH|YEU|LEN|XUONG|DO\s+LA|DOLA)\b"],
    "VND": [r"\bTY\s+GIA\s+(?:USD\s*/\s*)?VND\b", r"[\d.,]+\s*(?:TY|TRIEU|NGHIN)?\s+VND\b", r"\b(?:TY|TRIEU|NGHIN)\s+VND\b", r"\bUSD\s*/\s*VND\b", r"\bVND\s*/\s*USD\b", r"\bDONG\s+VND\b"],
    "VUA": [r"\bVUA\s+(?:QUA|MOI|DUOC|TANG|GIAM|CONG\s+BO|RA\s+MAT|CHO\s+BIET)\b"],
}
AROUND = 56


def universe(listing: DataFrame) -> DataFrame:
    """code: distinct upper-case symbols of two letters or more of shares; words that mean that there is none are no codes."""
    codes = listing.where("lower(coalesce(type, 'stock')) = 'stock'").select(F.upper(F.trim("symbol")).alias("code"))
    return codes.where((F.length("code") >= 2) & ~F.lower("code").isin(*sorted(_NO_TEXT))).distinct()


#: Texts that mean that there is none.
_NO_TEXT = frozenset(["nan", "none", "<na>"])
_TOKEN = re.compile("[A-Z0-9]+")


class _Fold(dict):
    """A table for ``str.translate``: each letter in capitals without its accents, filled as letters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn").upper()
        return self[code]


_FOLD = _Fold()


def _folded(value: str | None) -> tuple[str, str]:
    """A text in NFC without line ends, and its upper-case form without accents."""
    raw = unicodedata.normalize("NFC", value or "").replace("\r", " ").replace("\n", " ")
    if raw.strip().lower() in _NO_TEXT:
        return "", ""
    return raw, raw.upper() if raw.isascii() else raw.translate(_FOLD)


def _places(raw: str) -> list[int] | None:
    """The place of each folded letter in ``raw``; None: the same."""
    sizes = [1] if raw.isascii() else [len(_FOLD[ord(c)]) for c in raw]
    return None if set(sizes) == {1} else [i for i, n in enumerate(sizes) for _ in range(n)]


def mention_candidates(news: DataFrame, codes: DataFrame, parts: tuple[str, ...] = ("title", "summary", "body_text"), most: int = 100_000) -> DataFrame:
    """article_id, part, start (from 0), code, raw token and the folded text around it, for every token that is a code.

    One pass over the texts, which are never shuffled.  Up to ``most`` codes travel to the tasks; of more, tokens are joined with them instead."""
    some = codes.select("code").where("code is not null").distinct().limit(most + 1).collect()
    wanted = news.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in some) if len(some) <= most else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in small(batches, parts):
            rows: list[tuple] = []
            for k, part in enumerate(parts):
                for i, value in enumerate(batch.column(part).to_pylist()):
                    raw, folded = _folded(value)
                    if known is not None and known.isdisjoint(_TOKEN.findall(folded)):
                        continue
                    place = _places(raw)
                    for m in _TOKEN.finditer(folded):
                        if known is None or m[0] in known:
                            a, b = m.span()
                            token = raw[a:b] if place is None else raw[place[a] : place[b - 1] + 1]
                            rows.append((i, k, a, m[0], token, folded[max(0, a - AROUND) : a], folded[b : b + AROUND]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("article_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=["article_id", "part", "start", "code", "token", "left", "right"])

    kind = news.schema["article_id"].dataType.simpleString()
    found = news.select("article_id", *(F.col(p).cast("string").alias(p) for p in parts)).mapInArrow(run, f"article_id {kind}, part int, start int, code string, token string, left string, right string")
    return found if len(some) <= most else found.join(codes.select("code").distinct(), "code", "left_semi").select(found.columns)


def mention_scores(candidates: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """Candidates with a positive score: context rules, then length; vetoed contexts go."""
    capital = (F.col("token") == F.upper("token")) & (F.upper("token") != F.lower("token"))  # digits alone are no capitals
    around = F.concat("left", "code", "right")
    veto = F.lit(False)
    for code, patterns in VETOES.items():
        for pattern in patterns:
            veto = veto | ((F.col("code") == code) & around.rlike(pattern))
    context = None
    for pattern, points, needs in LEFT_RULES:
        hit = F.col("left").rlike(pattern) & (capital if needs else F.lit(True))
        context = F.when(hit, points) if context is None else context.when(hit, points)
    right = F.ltrim("right")
    context = context.when(F.rtrim("left").endswith("(") & right.startswith(")") & capital, 80).when(F.col("right").rlike(r"^\s*[-:]\s*[\d+%-]") & capital, 70).when(right.startswith("(") & capital, 55).otherwise(0)
    bonus = F.when(capital, 10).otherwise(0)
    plain_score = F.when(~F.col("code").isin(*blocked) & (F.length("code") > 3), 60 + bonus).when(~F.col("code").isin(*blocked) & capital, 55).otherwise(0)
    return candidates.where(~veto).withColumn("score", F.when(context > 0, context + bonus).otherwise(plain_score)).where("score > 0")


def ranked_mentions(scored: DataFrame) -> DataFrame:
    """article_id, mentions: each code once, at its best place; order by score with the part's bonus, part, place, code."""
    total = F.col("score") + F.when(F.col("part") == 0, 80).when(F.col("part") == 1, 40).otherwise(0)
    best = ranked_dedupe(scored.withColumn("total", total), ["article_id", "code"], [F.desc("total"), F.asc("part"), F.asc("start")])
    return best.groupBy("article_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "part", "start", "code"))), lambda x: x["code"]).alias("mentions"))


def blocked_without_context(news: DataFrame, codes: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """article_id and ticker of articles whose given ticker is a blocked code that their texts do not mention, in its context, as one of ``codes``."""
    given = news.withColumn("ticker", F.upper(F.trim("ticker"))).where(F.col("ticker").isin(*blocked))
    scored = mention_scores(mention_candidates(given, codes.where(F.col("code").isin(*blocked))), blocked).select("article_id", F.col("code").alias("ticker")).distinct()
    return given.select("article_id", "ticker").join(scored, ["article_id", "ticker"], "left_anti")


# --- addresses and ids

def content_id(url, *others) -> Column:
    """SHA-256 of the normal address, or of the other parts where there is none."""
    u = normal_url(url)
    return F.sha2(F.when(F.coalesce(u, F.lit("")) != "", u).otherwise(F.concat_ws("\n", *others)), 256)


def document_id(*parts) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)))


def source_label(name, url) -> Column:
    label_ = F.trim(F.coalesce(_c(name), F.lit("")))
    return F.when(label_ != "", F.concat(label_, F.lit("_rss"))).otherwise(F.concat(F.lit("rss_"), F.lower(F.try_parse_url(url, F.lit("HOST")))))


def safe_name(x, most: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit(most))


# --- document classes

#: Words of classes in order, of languages, and of periods, in normalised titles.
CLASS_WORDS = [
    ("explanation", ("giai trinh", "explanation", "relating to fss", "relating to the fss")), ("disclosure", ("cbtt", "cong bo thong tin", "disclosure")), ("announcement", ("nghi quyet", "resolution")),
    ("financial_statement_consolidated", ("hop nhat", "consolidated")), ("financial_statement_separate", ("bao cao tai chinh", "financial statements", "cong ty me", "parent company")),
]
VI_WORDS = ("bao cao tai chinh", "tai chinh", "kiem toan", "hop nhat", "giai trinh", "quy", "nam", "ban nien", "thang", "tong cong ty", "cong ty me")
EN_WORDS = ("financial statements", "quarterly report", "annual report", "reviewed interim", "audited", "independent auditor")
VI_SCRIPT = "[Ḁ-ỿàáãâăèéêìíĩòóõôơùúũưỳýđÀÁÃÂĂÈÉÊÌÍĨÒÓÕÔƠÙÚŨƯỲÝĐ]"
QUARTERS = [("Q1", r"\bq\s*1\b|\bquy\s*(1|i)\b"), ("Q2", r"\bq\s*2\b|\bquy\s*(2|ii)\b"), ("Q3", r"\bq\s*3\b|\bquy\s*(3|iii)\b"), ("Q4", r"\bq\s*4\b|\bquy\s*(4|iv)\b")]


def _has(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def document_class(norm: Column) -> Column:
    out = None
    for name, words in CLASS_WORDS:
        out = F.when(_has(norm, words), name) if out is None else out.when(_has(norm, words), name)
    return out.otherwise("unknown")


def file_name(url: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(F.coalesce(url, F.lit("")), "/", -1)


def document_language(name: Column, raw: Column, norm: Column) -> Column:
    """By the file's name, title and name together, and these normalised."""
    script = raw.rlike(VI_SCRIPT)
    return F.when(name.rlike("(?i)[_.-]vi[_.-]"), "VI").when(name.rlike("(?i)[_.-]en[_.-]") & ~script, "EN").when(script, "VI").when(_has(norm, EN_WORDS) & ~_has(norm, VI_WORDS), "EN").when(_has(norm, VI_WORDS), "VI").otherwise("UNKNOWN")


def document_period(norm: Column, title: Column, url: Column) -> Column:
    year = F.coalesce(F.nullif(F.regexp_extract(title, r"(20\d{2})", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"(20\d{2})", 1), F.lit("")), F.lit("UNKNOWN"))
    part = None
    for name, pattern in QUARTERS:
        part = F.when(norm.rlike(pattern), name) if part is None else part.when(norm.rlike(pattern), name)
    part = part.when(_has(norm, ("6 thang", "ban nien", "half year", "interim 6")), "H1").when(_has(norm, ("9 thang", "nine month")), "9M").when(_has(norm, ("nam", "annual", "year ended")), "ANNUAL").otherwise("GENERAL")
    return F.concat_ws("-", year, part)


def document_priority(kind: Column, language: Column, allow_en: bool = False) -> Column:
    """1 to 6 for financial statements by class and language, 99 for what is no candidate."""
    whole, statement = kind == "financial_statement_consolidated", kind.startswith("financial_statement")
    by_language = F.when(language == "EN", F.when(F.lit(allow_en), F.when(whole, 5).otherwise(6)).otherwise(99)).when(language == "UNKNOWN", F.when(whole, 3).otherwise(4)).otherwise(F.when(whole, 1).otherwise(2))
    return F.when(statement, by_language).otherwise(99)


def classify_documents(docs: DataFrame, allow_en: bool = False) -> DataFrame:
    name = file_name(F.col("url_pdf"))
    raw = F.concat_ws(" ", "title", name)
    d = once(docs, "__of", F.struct(normal_title("title").alias("norm"), name.alias("name"), raw.alias("raw"), normal_title(raw).alias("raw_norm")))
    norm = F.col("__of.norm")
    kinds = F.struct(document_class(norm).alias("doc_class"), document_language(F.col("__of.name"), F.col("__of.raw"), F.col("__of.raw_norm")).alias("language"), document_period(norm, F.col("title"), F.col("url_pdf")).alias("period_key"))
    d = once(d, "__kinds", kinds).withColumns({"normalized_title": norm, "doc_class": F.col("__kinds.doc_class"), "language": F.col("__kinds.language"), "period_key": F.col("__kinds.period_key")}).drop("__of", "__kinds")
    d = d.withColumn("canonical_priority", document_priority(F.col("doc_class"), F.col("language"), allow_en))
    return d.withColumn("keep_for_parse", F.col("canonical_priority") < 99)


def canonical_documents(classified: DataFrame) -> DataFrame:
    return ranked_dedupe(classified.where("keep_for_parse"), ["ticker", "period_key"], [F.asc("canonical_priority"), F.asc("url_pdf")])


def ingest_decision(allow_en: bool = False, allow_unknown: bool = True) -> Column:
    """download, or skipped with the reason."""
    kind, language = F.col("doc_class"), F.col("language")
    return (
        F.when(~kind.startswith("financial_statement"), F.concat(F.lit("skipped_doc_class:"), kind)).when(language == "VI", "download")
        .when(language == "EN", "download" if allow_en else "skipped_language_en").when(language == "UNKNOWN", "download" if allow_unknown else "skipped_language_unknown").otherwise("skipped_language")
    )


#: Words that documents of a list must hold, one of each, and must not hold, by mode: yearly statements alone, or all.  They are looked for in
#: attachment name, title and address together, in lower case without accents, so words with capitals would never be found.
LIST_INCLUDE = ("bctc", "bao cao tai chinh", "bc tai chinh")
LIST_ANNUAL = ("nam", "kiem toan", "da kiem toan", "hop nhat")
LIST_EXCLUDE = ("uponrequest", "upon request", "tai lieu hop", "nghi quyet")
LIST_EXCLUDE_ANNUAL = ("nghi quyet", "resolution")


def is_statement(attachment: Column | None, title: Column, url: Column, strict_annual: bool = False) -> Column:
    return _let(listed_text(attachment, title, url), lambda t: _is_listed(t, strict_annual))


def listed_text(attachment: Column | None, title: Column, url: Column) -> Column:
    return normal_title(F.concat_ws(" ", *([] if attachment is None else [attachment]), title, url))


def _is_listed(t: Column, strict_annual: bool) -> Column:
    if strict_annual:
        return _has(t, LIST_INCLUDE) & _has(t, LIST_ANNUAL) & ~_has(t, LIST_EXCLUDE_ANNUAL)
    return _has(t, LIST_INCLUDE) & ~_has(t, LIST_EXCLUDE)


def first_year(*texts: Column) -> Column:
    """The first year of this century in the first of the texts that holds one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(t, r"(20\d{2})", 1), F.lit("")) for t in texts))


def filter_document_list(docs: DataFrame, tickers: list[str] | None = None, strict_annual: bool = False, attachment: str | None = None) -> DataFrame:
    """Rows of statements by title, address and, if given, the column of attachment names; with ``year`` from the title."""
    if tickers is not None:
        docs = docs.where(F.upper("ticker").isin(*(x.upper() for x in tickers)))
    docs = once(docs, "__text", listed_text(None if attachment is None else F.col(attachment), F.col("title"), F.col("url_pdf")))
    return docs.where(_is_listed(F.col("__text"), strict_annual)).drop("__text").withColumn("year", first_year(F.col("title")))


# --- pages

def stripped(x) -> Column:
    """Text without tags, the common entities decoded, white space collapsed."""
    t = F.regexp_replace(_c(x), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0b]+", " "))


def page_date(x) -> Column:
    """ISO, dd/MM/yyyy[, HH:mm] or dd-MM-yyyy - HH:mm in local time, as UTC."""
    t = F.trim(_c(x))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*([+-]\d{2}:?\d{2}|Z)$"), F.try_to_timestamp(t))
    day = F.regexp_extract(t, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 0)
    clock = F.regexp_extract(t, r"(\d{1,2}:\d{2})", 1)
    parts = F.split(F.regexp_replace(day, "/", "-"), "-")
    built = F.concat(parts[2], F.lit("-"), F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0"), F.lit("-"), F.lpad(parts[0], 2, "0"), F.lit(" "), F.when(clock == "", "00:00").otherwise(F.lpad(clock, 5, "0")))
    local = F.when(day != "", F.try_to_timestamp(built, F.lit("yyyy-MM-dd HH:mm")))
    plain_iso = F.try_to_timestamp(F.replace(F.left(t, F.lit(16)), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))
    return F.coalesce(iso, F.to_utc_timestamp(local, ZONE), F.to_utc_timestamp(plain_iso, ZONE))


#: Selectors of titles, summaries and dates, and keys of meta tags, in the order in which they are tried.
TITLE_CSS = ("h1.title-detail", "h1.title", "article h1", "main h1", "h1")
SUMMARY_CSS = ("p.description", "h2.sapo", "h2.lead", ".sapo", ".news_sapo", "article header p")
DATE_CSS = ("span.date", "span.pdate", "span.time", "p.time", ".date")
TITLE_META, SUMMARY_META = ("og:title", "twitter:title"), ("og:description", "twitter:description", "description")
DATE_META = ("article:published_time", "og:article:published_time", "pubdate", "publish-date")
#: Types of JSON-LD objects that are articles, and their fields, the first that has a value counts.
ARTICLE_TYPE = "newsarticle|article|blogposting|report"
TOLD = {"title": ("headline", "name"), "summary": ("description", "abstract"), "body_text": ("articleBody", "text"), "published_at": ("datePublished", "dateCreated", "dateModified")}


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def meta_content(elements: Column, *keys: str) -> Column:
    """The content of the first of the meta tags, by property before name, that has one."""

    def of(key: str, attr: str) -> Column:
        hit = F.filter(elements, lambda e: (e["name"] == "meta") & (F.try_element_at(e["attrs"], F.lit(attr)) == key))
        return F.get(F.transform(hit, lambda e: F.coalesce(F.try_element_at(e["attrs"], F.lit("content")), F.lit(""))), F.lit(0))

    return F.coalesce(*(_some(F.regexp_replace(F.coalesce(of(k, "property"), of(k, "name")), r"\s+", " ")) for k in keys))


def told_article(told: Column) -> Column:
    """title, summary, body_text and published_at of the first JSON-LD object that is an article with a title or a body; a date, and a summary that it
    lacks, of other article objects too.  Scripts hold one object, a list, or a ``@graph``."""
    whole = F.filter(F.transform(told, F.try_parse_json), lambda v: v.isNotNull())
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    value = lambda v, *names: F.coalesce(*(_some(F.try_variant_get(v, f"$['{n}']", "string")) for n in names))
    one = lambda v: F.struct(value(v, "@type", "type").alias("type"), *(value(v, *names).alias(field) for field, names in TOLD.items()))
    objects = F.transform(F.flatten(F.transform(whole, listed)), one)
    some = lambda os, field: F.get(F.filter(F.transform(os, lambda o: o[field]), lambda x: x.isNotNull()), F.lit(0))

    def fields(articles: Column) -> Column:
        told_most = F.get(F.filter(articles, lambda o: o["title"].isNotNull() | o["body_text"].isNotNull()), F.lit(0))
        return F.struct(told_most["title"].alias("title"), F.coalesce(told_most["summary"], some(articles, "summary")).alias("summary"), told_most["body_text"].alias("body_text"), some(articles, "published_at").alias("published_at"))

    return _let(F.filter(objects, lambda o: F.lower(o["type"]).rlike(ARTICLE_TYPE)), fields)


def page_article(pages: DataFrame, references: str = "html") -> DataFrame:
    """page_id, title, summary, body_text, published_at: JSON-LD first, then meta tags, then the page's own elements: titles of 8 characters or more
    by selector or from ``title`` without the site's name, summaries of 20 to 600 by selector, the first date that can be read, the paragraphs of
    the best container, or else all paragraphs, a line each."""
    pages = with_elements(pages.select("page_id", "html"), references=references).withColumn("article", told_article(F.col("told")))
    e, told = F.col("elements"), F.col("article")
    within = lambda c, least, most: F.when(F.length(c).between(least, most), c)
    own_title = F.regexp_replace(one_text("title"), r"\s*[-|]\s*.*$", "")
    title = F.coalesce(told["title"], meta_content(e, *TITLE_META), *(_let(one_text(css), lambda t: within(t, 8, 1 << 30)) for css in TITLE_CSS), within(F.trim(own_title), 8, 1 << 30))
    summary = F.coalesce(told["summary"], meta_content(e, *SUMMARY_META), *(_let(one_text(css), lambda t: within(t, 20, 600)) for css in SUMMARY_CSS))
    times = F.transform(F.filter(e, lambda x: x["name"] == "time"), lambda x: page_date(F.coalesce(_some(F.try_element_at(x["attrs"], F.lit("datetime"))), text_of(x))))
    date = F.coalesce(
        page_date(told["published_at"]), page_date(meta_content(e, *DATE_META)), F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0)), *(_let(one_text(css), page_date) for css in DATE_CSS)
    )
    paragraphs = F.filter(F.transform(F.filter(e, lambda x: x["name"] == "p"), text_of), lambda t: t != "")
    body = F.coalesce(F.nullif(stripped(told["body_text"]), F.lit("")), best_body(e), F.array_join(paragraphs, "\n"))
    return pages.select("page_id", title.alias("title"), summary.alias("summary"), body.alias("body_text"), date.alias("published_at"))


def selected_fields(pages: DataFrame, title: str | None = None, summary: str | None = None, body: str | None = None, published_at: str | None = None, references: str = "html") -> DataFrame:
    """page_id, title, summary, body_text, published_at by the CSS selectors of a site; null where there is no selector, no element or no text."""
    none = F.lit(None).cast("string")
    text = lambda css, of: none if css is None else _some(of(css))
    return with_elements(pages.select("page_id", "html"), references=references).select(
        "page_id", text(title, one_text).alias("title"), text(summary, one_text).alias("summary"), text(body, all_texts).alias("body_text"), page_date(text(published_at, one_text)).alias("published_at"))


def page_fields(pages: DataFrame, css: dict[str, str], mode: str = "hybrid", fallback: DataFrame | None = None, references: str = "html") -> DataFrame:
    """The fields of pages by a site's selectors (``css``), by the heuristics of :func:`page_article` (``heuristic``), or by selectors first (``hybrid``).

    ``fallback`` (page_id, title) has the titles of links to the pages, used where nothing else gives one.  ``references``: see ``pages.REFERENCES``."""
    fields = ["title", "summary", "body_text", "published_at"]
    chosen, found = lambda: selected_fields(pages, **css, references=references), lambda: page_article(pages, references)
    out = chosen() if mode == "css" else found() if mode == "heuristic" else merged_fields(chosen(), found(), "page_id", fields)
    if fallback is None:
        return out
    named = fallback.select(F.col("page_id").alias("of"), F.col("title").alias("link_title"))
    return out.join(named, F.col("page_id") == F.col("of"), "left").select("page_id", F.coalesce("title", "link_title").alias("title"), *fields[1:])


def listed_articles(lists: DataFrame, pages: DataFrame, link_css: str, css: dict[str, str], n: int, mode: str = "hybrid", part: str | None = None) -> DataFrame:
    """list_id, page_id, url, title, summary, body_text, published_at of the pages that the first ``n`` links of list pages (list_id, url, html) lead to, each
    page at its first link; pages that have neither a date nor a body go.  A list may be many pages, numbered by the column ``part``: each is parsed
    alone, and the first ``n`` links are those of the list as a whole."""
    linked = with_elements(lists.select("list_id", (F.lit(0) if part is None else F.col(part)).alias("part"), "url", "html"))
    links = F.transform(F.slice(select(F.col("elements"), link_css), 1, n), lambda e: F.struct(F.try_element_at(e["attrs"], F.lit("href")).alias("href"), text_of(e).alias("text"), e["at"].alias("at")))
    linked = linked.select("list_id", "part", F.col("url").alias("base"), F.explode(links).alias("x"))
    linked = linked if part is None else top_per_group(linked, ["list_id"], [F.asc("part"), F.asc("x.at")], n)
    linked = linked.where("x.href <> '' and x.text <> ''").select("list_id", "part", "x.at", F.col("x.text").alias("link_title"), _let(absolute_url(F.col("base"), F.col("x.href")), normal_url).alias("address")).where("address rlike '^https?://'")
    linked = ranked_dedupe(linked, ["address"], [F.asc("list_id"), F.asc("part"), F.asc("at")])
    found = pages.select("page_id", "html", normal_url(F.col("url")).alias("own")).join(linked, F.col("own") == F.col("address"))
    found = ranked_dedupe(found, ["address"], [F.asc("page_id")])
    fields = page_fields(found, css, mode, found.select("page_id", F.col("link_title").alias("title"))).where("published_at is not null or coalesce(body_text, '') <> ''")
    places = found.select(F.col("page_id").alias("of"), "list_id", F.col("address").alias("url"))
    return fields.join(places, F.col("page_id") == F.col("of")).select("list_id", "page_id", "url", "title", "summary", "body_text", "published_at")


def merged_fields(chosen: DataFrame, found: DataFrame, key: str, fields: list[str], mode: str = "hybrid") -> DataFrame:
    """Per field the selector's value, else the heuristic's; or one of both alone.  Empty texts are none."""
    f = found.select(F.col(key).alias("of"), *(F.col(c).alias(f"other_{k}") for k, c in enumerate(fields)))
    some = lambda df, c, name: F.nullif(F.col(name), F.lit("")) if df.schema[c].dataType.typeName() == "string" else F.col(name)
    pick = {
        "css": lambda c, o: some(chosen, c, c), "heuristic": lambda c, o: some(found, c, o),
        "hybrid": lambda c, o: F.coalesce(some(chosen, c, c), some(found, c, o)),
    }[mode]
    return chosen.join(f, F.col(key) == F.col("of"), "left").select(key, *(pick(c, f"other_{k}").alias(c) for k, c in enumerate(fields)))


#: Names of fields of feed entries, the first that has a value counts.
FEED_FIELDS = {
    "title": ("title", "headline", "name"), "url": ("link", "url", "id"), "summary": ("summary", "description", "subtitle"), "content": ("content",),
    "published_at": ("published_parsed", "updated_parsed", "created_parsed", "dc_date", "date", "published", "published_at", "pubDate", "updated", "created", "pubdate", "issued", "modified", "isoDate", "timestamp"),
}


def capped_per_feed(entries: DataFrame, feed: str, order: str, n: int) -> DataFrame:
    return top_per_group(entries, [feed], [F.asc(order)], n).drop("rank")


def feed_entries(entries: DataFrame, feed: str, order: str, n: int, label: str | None = None, codes: DataFrame | None = None) -> DataFrame:
    """article_id, source, title, summary, body_text, url, published_at and, with ``codes``, the ticker of the first n entries of each feed address that have a title
    and an address.  Entries without one count among the n."""
    first = capped_per_feed(entries, feed, order, n)
    field = lambda name: F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in FEED_FIELDS[name] if c in entries.columns), F.lit(""))
    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") if entries.schema[c].dataType.typeName() == "timestamp" else F.col(c).cast("string") for c in FEED_FIELDS["published_at"] if c in entries.columns]
    squeezed = F.trim(F.regexp_replace(field("title"), r"\s+", " "))
    d = first.select(
        source_label(F.col(label) if label else F.lit(""), F.col(feed)).alias("source"), squeezed.alias("title"), stripped(field("summary")).alias("summary"), stripped(field("content")).alias("body_text"), normal_url(field("url")).alias("url"),
        page_date(F.coalesce(*(F.nullif(t, F.lit("")) for t in times), F.lit(None).cast("string"))).alias("published_at"),
    )
    d = d.where((F.col("title") != "") & F.col("url").rlike("^https?://")).select(content_id(F.col("url")).alias("article_id"), "*")
    if codes is None:
        return d
    said = ranked_mentions(mention_scores(mention_candidates(d.dropDuplicates(["article_id"]), codes))).select("article_id", F.get("mentions", F.lit(0)).alias("ticker"))
    return d.join(said, "article_id", "left")


def attachments(pages: DataFrame, listing: DataFrame, key: str, origin: str, strict_annual: bool = False) -> DataFrame:
    """One row for each PDF that a listing row's page (key, html) links to and that is a statement: the key, ticker, title (the row's and the link's text),
    parent_title, attachment_name, published_at, url_pdf in full, and year (from the row's title, else its date).

    ``listing`` has the key, ticker, title and published_at; an address that a page links to twice counts with its first text."""
    parsed = with_elements(pages.select(F.col(key).alias("of"), "html"))
    pdf = F.filter("elements", lambda e: (e["name"] == "a") & F.lower(F.try_element_at(e["attrs"], F.lit("href"))).contains(".pdf"))
    links = F.transform(pdf, lambda e: F.struct(e["at"].alias("at"), text_of(e).alias("text"), F.trim(F.try_element_at(e["attrs"], F.lit("href"))).alias("href")))
    each = parsed.select("of", F.explode(links).alias("x")).select("of", "x.at", F.col("x.text").alias("name"), absolute_url(F.lit(f"{origin}/"), F.col("x.href")).alias("url_pdf"))
    each = ranked_dedupe(each, ["of", "url_pdf"], [F.asc("at")])
    at = F.col("published_at")  # a time says its year, whatever the century; a text is searched for one
    dated = F.year(at).cast("string") if listing.schema["published_at"].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else first_year(at)
    rows = listing.select(key, "ticker", F.col("title").alias("parent_title"), at.cast("string").alias("published_at"), dated.alias("dated"))
    both = rows.join(each, F.col(key) == F.col("of"))
    title = F.trim(F.concat_ws(" ", "parent_title", "name"))
    kept = both.where(is_statement(F.col("name"), title, F.col("url_pdf"), strict_annual))
    year = F.coalesce(first_year(F.col("parent_title")), "dated")
    return kept.select(key, F.upper(F.trim("ticker")).alias("ticker"), title.alias("title"), "parent_title", _some(F.col("name")).alias("attachment_name"), "published_at", "url_pdf", year.alias("year"))


def checked_files(files: DataFrame, least: int = 100) -> DataFrame:
    """path, size, header, trailer, ok, sha256 of a binaryFile scan."""
    head, tail = F.substring("content", 1, 5), F.substring("content", -1024, 1024)
    valid = head == F.to_binary(F.lit("255044462d"), F.lit("hex"))
    ends = F.contains(tail, F.to_binary(F.lit("2525454f46"), F.lit("hex")))
    whole = F.length("content") == F.col("length")
    return files.select("path", "length", valid.alias("valid_header"), ends.alias("has_trailer"), (valid & ends & whole & (F.col("length") >= least)).alias("ok"), F.sha2("content", 256).alias("sha256"))
