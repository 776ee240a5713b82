"""Registered serving queries, with fixed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.plans import gold, serve, silver
from quotemill.plans.gold_queries import ALL, DIRECTORY, INDICATOR_COLUMNS, PROFILE, VIEWS, WIDE, _COLS, _PIVOT, company_profile, directory, r, rounded_all
from quotemill.plans.registry import query
from quotemill.plans.silver_queries import BOARD, FILINGS
from quotemill.plans.text_queries import NEWS, facts, signals
from quotemill.plans import gold as _gold
from quotemill.sources import sinks
from quotemill.sources.proxy import Tables

S = "S00001"
DAY = "1995-06-30"


@query(f"select ticker, trading_date, open, high, low, close, volume, {r('daily_return')} as daily_return from returns where ticker = '{S}' and trading_date <= date '{DAY}' order by trading_date desc limit 20", **VIEWS)
def q_prices(t: Tables) -> DataFrame:
    return rounded_all(serve.prices(t.price(), S.lower(), last=DAY), ["daily_return"]).select("ticker", "trading_date", "open", "high", "low", "close", "volume", "daily_return")


@query(f"select ticker, trading_date, {_COLS}, {r('volatility20')} as volatility20 from (select *, stddev_pop(daily_return) over (partition by ticker order by trading_date rows 19 preceding) as volatility20 from indicators) where ticker = '{S}' and trading_date >= date '1994-01-01' order by trading_date desc limit 20 offset 20", **VIEWS)
def q_indicators(t: Tables) -> DataFrame:
    return rounded_all(serve.indicators(t.price(), S, first="1994-01-01", number=2), [*INDICATOR_COLUMNS, "volatility20"]).select("ticker", "trading_date", *INDICATOR_COLUMNS, "volatility20")


@query(f"select p.trading_date, {_PIVOT}, b.advances, b.declines from pivoted p join breadth b on p.trading_date = b.trading_date order by p.trading_date desc limit 1", **ALL)
def q_market_overview(t: Tables) -> DataFrame:
    names = [f"{n}_{s}" for n in gold.INDEXES.values() for s in ("close", "return")]
    return rounded_all(serve.overview(gold.market_overview(t.price(), t.index_price())), [n for n in names if n.endswith("return")]).select("trading_date", *names, "advances", "declines")


def _board(t: Tables) -> DataFrame:
    return gold.price_board(silver.board_latest(silver.clean_board(t.board())))


@query("select upper(symbol) as symbol, trading_date, close_price from last_board where not is_suspicious and upper(symbol) = 'U00007' order by trading_date desc limit 30", **BOARD)
def q_board(t: Tables) -> DataFrame:
    return serve.board(_board(t), "u00007").select("symbol", "trading_date", "close_price")


@query("select upper(symbol) as symbol, trading_date, foreign_buy - foreign_sell as foreign_net from last_board where not is_suspicious and upper(symbol) = 'U00008' and trading_date >= date '1995-01-01' order by trading_date desc limit 10", **BOARD)
def q_foreign_flow(t: Tables) -> DataFrame:
    return serve.board(_board(t), "U00008", first="1995-01-01", n=10).select("symbol", "trading_date", "foreign_net")


@query("select ticker, exchange, organ_name, latest_close from profile where ticker = 'S00001'", **PROFILE)
def q_company(t: Tables) -> DataFrame:
    return serve.company(company_profile(t), directory(t), S).select("ticker", "exchange", "organ_name", "latest_close")


@query("select d.ticker, d.exchange, d.organ_name, p.latest_close from directory d left join profile p on d.ticker = p.ticker where d.ticker in ('S00001', 'S00004')", **PROFILE, **DIRECTORY)
def fallback_lookup(t: Tables) -> DataFrame:
    """One ticker with a profile, one without."""
    p, d = company_profile(t), directory(t)
    return serve.company(p, d, "S00001").unionByName(serve.company(p, d, "S00004")).select("ticker", "exchange", "organ_name", "latest_close")


@query("select d.ticker, d.latest_close, coalesce(x.has_price, false) as has_price, coalesce(x.has_news, false) as has_news, coalesce(x.has_docs, false) as has_docs from profile d left join directory x on d.ticker = x.ticker", **PROFILE, **DIRECTORY)
def profile_with_flags(t: Tables) -> DataFrame:
    return serve.profile_with_flags(company_profile(t), directory(t)).select("ticker", "latest_close", "has_price", "has_news", "has_docs")


def _summary(t: Tables) -> DataFrame:
    return gold.financial_summary(t.ratio())


_BOTH = "(select * from wide union all select * from annual)"


@query(f"select * from {_BOTH} where ticker = '{S}' and period_type = 'annual'", **WIDE)
def q_financials(t: Tables) -> DataFrame:
    return serve.financials(_summary(t), S, "annual")


@query(f"select * from {_BOTH} where ticker = '{S}' and coalesce({', '.join(_gold.SUMMARY_ITEMS)}) is not null order by period desc, period_type limit 10", **WIDE)
def q_financials_visible(t: Tables) -> DataFrame:
    return serve.visible_financials(_summary(t), list(_gold.SUMMARY_ITEMS), S, 10)


@query("select * from directory", **PROFILE, **DIRECTORY)
def q_tickers(t: Tables) -> DataFrame:
    return directory(t).orderBy("ticker")


@query("select ticker, organ_name from directory where lower(ticker) like '%1%' or lower(organ_name) like '%1%' order by ticker limit 12", **PROFILE, **DIRECTORY)
def q_ticker_search(t: Tables) -> DataFrame:
    return serve.search_tickers(directory(t), "1").select("ticker", "organ_name")


_ORDER = "order by published_at desc nulls last, article_id, ticker"


@query(f"select article_id, ticker, source, published_at from facts where (title ilike '%the%' or summary ilike '%the%' or body_text ilike '%the%') and sentiment_label = 'positive' {_ORDER} limit 20 offset 20", **NEWS)
def q_news_articles(t: Tables) -> DataFrame:
    return serve.articles(facts(t), search="the", sentiment="positive", number=2).select("article_id", "ticker", "source", "published_at")


@query(f"select article_id, ticker, source, published_at from facts where (title ilike '%o_an%' or summary ilike '%o_an%' or body_text ilike '%o_an%') {_ORDER} limit 20", **NEWS)
def q_news_indexed(t: Tables) -> DataFrame:
    """By the index of grams, which is stored first."""
    path = sinks.scratch(t.spark, "articles")
    serve.index_news(t.news(), path)
    return serve.news_by_index(t.spark, path, "o_an").select("article_id", "ticker", "source", "published_at")


@query(f"select article_id, ticker, published_at from facts {_ORDER} limit 50", **NEWS)
def q_news_market(t: Tables) -> DataFrame:
    return serve.articles(facts(t), size=50).select("article_id", "ticker", "published_at")


@query(f"select article_id, ticker, published_at from facts where ticker = 'S00003' {_ORDER} limit 20", **NEWS)
def q_news_symbol(t: Tables) -> DataFrame:
    return serve.articles(facts(t), symbol="s00003").select("article_id", "ticker", "published_at")


@query(f"select article_id, ticker from facts where source ilike 'src3' and coalesce(cast((published_at + interval 7 hour) as date), published_date) >= date '1995-01-05' {_ORDER} limit 20", **NEWS)
def optional_filters(t: Tables) -> DataFrame:
    return serve.articles(facts(t), source="src3", first="1995-01-05").select("article_id", "ticker")


@query(f"select article_id, ticker, published_at from facts {_ORDER} limit 5", **NEWS)
def sort_multi_nulls(t: Tables) -> DataFrame:
    return serve.articles(facts(t), size=5).select("article_id", "ticker", "published_at")


_PRICE_ORDER = [("trading_date", True), ("volume", True), ("ticker", False)]
_BY_PRICE = "order by trading_date desc, volume desc, ticker"


@query(f"select ticker, trading_date, close from price {_BY_PRICE} limit 50 offset (select (count(*) // 100) * 50 from price)")
def page_by_number(t: Tables) -> DataFrame:
    """A page in the middle of all prices, found by counts of ranges."""
    price = t.price()
    return serve.numbered_page(price, _PRICE_ORDER, price.count() // 100 + 1, 50, 64).select("ticker", "trading_date", "close")


@query(f"select article_id, source from (select *, row_number() over (order by published_at desc nulls last, article_id desc) as k from (select distinct article_id, source, published_at from news)) where k between 41 and 60")
def page_by_key(t: Tables) -> DataFrame:
    """The third page of articles, each behind the last key of the one before; articles without a time come last."""
    news, order, last = t.news().select("article_id", "source", "published_at"), [("published_at", True), ("article_id", True)], None
    for _ in range(2):
        row = serve.page_after(news, order, last, 20).collect()[-1]
        last = [row["published_at"], row["article_id"]]
    return serve.page_after(news, order, last, 20).select("article_id", "source")


@query("select count(*) as total, 3 as page, 20 as page_size, count(*) > 60 as has_more from facts", **NEWS)
def limit_offset_page(t: Tables) -> DataFrame:
    return serve.page_info(facts(t), 3, 20)


@query("select ticker, trading_date, news_count, weighted_sentiment, news_signal from signal where ticker = 'S00003' order by trading_date desc limit 1", **NEWS)
def q_news_signal_latest(t: Tables) -> DataFrame:
    return signals(t).where("ticker = 'S00003'").orderBy(F.desc("trading_date")).limit(1).select("ticker", "trading_date", "news_count", "weighted_sentiment", "news_signal")


@query("select ticker, trading_date, news_count, weighted_sentiment, news_signal from signal where ticker = 'S00003' order by trading_date desc limit 20", **NEWS)
def q_news_signals(t: Tables) -> DataFrame:
    return serve.page(signals(t).where("ticker = 'S00003'"), [F.desc("trading_date")]).select("ticker", "trading_date", "news_count", "weighted_sentiment", "news_signal")


@query(f"select ticker, trading_date, {r('positive_count::double / news_count')} as positive_share, {r('negative_count::double / news_count')} as negative_share, {r('neutral_count::double / news_count')} as neutral_share from signal", **NEWS)
def q_sentiment_share(t: Tables) -> DataFrame:
    return serve.sentiment_share(signals(t))


def _docs(t: Tables) -> DataFrame:
    return silver.web_filings(silver.clean_filings(t.filings()))


_DOCS = "(select * from kept_filings where display_status = 'available')"


@query(f"select doc_id, ticker, title, period_key from {_DOCS} where title ilike '%q%' order by published_at desc nulls last, doc_id limit 20", **FILINGS)
def q_docs(t: Tables) -> DataFrame:
    return serve.documents(_docs(t), search="q").select("doc_id", "ticker", "title", "period_key")


@query(f"select doc_id, ticker, title, period_key from {_DOCS} where title ilike '%quý%' order by published_at desc nulls last, doc_id limit 20", **FILINGS)
def q_docs_indexed(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "filings")
    serve.index_documents(_docs(t), path)
    return serve.documents_by_index(t.spark, path, "QUÝ").select("doc_id", "ticker", "title", "period_key")


@query(f"select doc_id, published_at from {_DOCS} order by published_at desc nulls last, doc_id limit 10", **FILINGS)
def q_docs_recent(t: Tables) -> DataFrame:
    return serve.documents(_docs(t), size=10).select("doc_id", "published_at")


@query(f"select doc_id, published_at from {_DOCS} order by published_at desc nulls last, doc_id limit 1", **FILINGS)
def topk_global(t: Tables) -> DataFrame:
    return serve.documents(_docs(t), size=1).select("doc_id", "published_at")


@query(f"select doc_id, ticker from {_DOCS} where ticker = 'S00009' order by published_at desc nulls last, doc_id limit 20", **FILINGS)
def q_docs_symbol(t: Tables) -> DataFrame:
    return serve.documents(_docs(t), symbol="s00009").select("doc_id", "ticker")


@query(f"select doc_id, ticker, title from {_DOCS} where doc_id = 'D12'", **FILINGS)
def q_doc_by_id(t: Tables) -> DataFrame:
    return _docs(t).where("doc_id = 'D12'").select("doc_id", "ticker", "title")


@query(f"select distinct regexp_extract(title, '20[0-9][0-9]') as year from {_DOCS}", **FILINGS)
def q_doc_years(t: Tables) -> DataFrame:
    return _docs(t).select(F.regexp_extract("title", "(20[0-9][0-9])", 1).alias("year")).distinct().orderBy(F.desc("year"))


@query(f"select ticker, trading_date, close from price where ticker = '{S}' and trading_date >= (select max(trading_date) from price where ticker = '{S}') - interval 90 day")
def q_price_range(t: Tables) -> DataFrame:
    return serve.recent_days(t.price(), S, 90).select("ticker", "trading_date", "close")
