"""Market-shaped inputs derived from the star-schema test tables, as DataFrames and, for oracles, in SQL.

Prices and quantities have two decimals and are summed as decimals, so results do not hang on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.rules import rounded

#: Item codes of the ratio proxy.
ITEMS = ["trailing_eps", "pe_ratio", "pb_ratio", "roe", "roa", "revenue"]


class Tables:
    """The proxy views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def trades(self) -> DataFrame:
        li = self.raw("lineitem")
        unit = F.round((F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(28,10)"), 2)
        return li.select(
            F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("ticker"), F.to_date("l_shipdate").alias("trading_date"), unit.cast("decimal(18,2)").alias("unit"),
            F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_discount").cast("decimal(18,2)").alias("discount"),
            F.col("l_tax").cast("decimal(18,2)").alias("tax"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.col("l_returnflag").alias("flag"),
        )

    def price(self) -> DataFrame:
        """Dealt by ticker before they are summed: the days of a ticker have one or two trades, and windows over a ticker need no further exchange."""
        t = self.trades().repartition("ticker").groupBy("ticker", "trading_date")
        return t.agg(
            F.min_by("unit", "ord").cast("double").alias("open"), F.max("unit").cast("double").alias("high"), F.min("unit").cast("double").alias("low"), F.max_by("unit", "ord").cast("double").alias("close"),
            F.sum("quantity").cast("long").alias("volume"), F.when(F.min("ord") % 3 != 0, F.sum("amount").cast("double")).alias("value"), F.max("ord").alias("fetched"),
        )

    def index_price(self) -> DataFrame:
        code = F.when(F.col("flag") == "A", "VNINDEX").when(F.col("flag") == "N", "VN30").otherwise("HNXINDEX")
        t = self.trades().groupBy(code.alias("index_code"), "trading_date")
        return t.agg(F.min_by("unit", "ord").cast("double").alias("open"), F.max("unit").cast("double").alias("high"), F.min("unit").cast("double").alias("low"), rounded(F.sum("unit").cast("double") / F.count("*"), 2).alias("close"), F.sum("quantity").cast("long").alias("volume"))

    def listing(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        return j.select(
            F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("symbol"), F.col("s_name").alias("organ_name"), F.when(F.col("r_regionkey") < 2, "HOSE").when(F.col("r_regionkey") < 4, "hnx").otherwise("UPCOM").alias("exchange"),
            F.when(F.col("s_suppkey") % 10 == 0, "bond").otherwise("Stock").alias("type"), F.col("s_suppkey").alias("ord"), F.col("n_name").alias("industry"), F.col("s_acctbal").alias("capital"),
        )

    def company(self) -> DataFrame:
        return self.listing().where("ord % 4 <> 0").select(
            F.col("symbol").alias("ticker"), F.col("industry").alias("company_type"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("ord").cast("int")).alias("founded_date"), F.when(F.col("ord") % 5 != 0, F.col("capital")).alias("charter_capital"), (F.col("ord") * 10).alias("number_of_employees"))

    def ratio(self) -> DataFrame:
        """Long form; one quarter in seven lacks a value."""
        t = self.trades().withColumns({"year": F.year("trading_date"), "quarter": F.quarter("trading_date")}).groupBy("ticker", "year", "quarter")
        sums = t.agg(F.sum("unit").cast("double").alias("u"), F.sum("discount").cast("double").alias("d"), F.sum("tax").cast("double").alias("t"), F.sum("quantity").cast("double").alias("q"), F.sum("amount").cast("double").alias("a"), F.count("*").alias("n"))
        values = {"trailing_eps": F.col("u") / F.col("n"), "pe_ratio": F.col("q") / F.col("n"), "pb_ratio": F.col("d") / F.col("n"), "roe": F.col("t") / F.col("n"), "roa": (F.col("t") + F.col("d")) / F.col("n"), "revenue": F.col("a")}
        wide = sums.select("ticker", "year", "quarter", *(rounded(v, 4).alias(k) for k, v in values.items())).repartition("ticker")  # narrow here, and what follows goes by ticker
        cells = F.array(*(F.struct(F.lit(k).alias("item_code"), F.col(k).alias("value")) for k in ITEMS))
        long = wide.select("ticker", "year", "quarter", F.inline(cells))  # unlike unpivot, keeps the rows known as dealt by ticker
        period = F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string"))
        return long.select("ticker", "item_code", period.alias("period"), F.lit("quarter").alias("period_type"), "year", "quarter", F.when((F.col("year") + F.col("quarter")) % 7 != 0, F.col("value")).alias("value"))

    def board(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("symbol"), F.col("ts").alias("snapshot_at"), F.col("event_id"), F.col("event_type").alias("exchange"), rounded("value", 2).alias("close_price"),
            rounded(F.col("value") - F.col("event_id") % 7, 2).alias("bid_price_1"), rounded(F.col("value") + F.col("event_id") % 5, 2).alias("ask_price_1"), rounded(F.col("value") + F.col("event_id") % 3 - 1, 2).alias("high_price"),
            rounded(F.col("value") - F.col("event_id") % 4, 2).alias("low_price"), (F.col("event_id") % 1000).alias("foreign_buy"), (F.col("event_id") % 700).alias("foreign_sell"), (F.col("event_id") % 1013 - 3).alias("volume"),
        )

    def news(self) -> DataFrame:
        d = self.raw("documents")
        code = lambda n: F.concat(F.lit("S"), F.lpad((F.col("doc_id") % n + 1).cast("string"), 5, "0"))
        mentions = F.filter(F.array(code(97), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), code(53))), F.when(F.col("doc_id") % 5 == 0, F.lit(""))), lambda x: x.isNotNull())
        published = F.timestamp_seconds(F.lit(788918400) + F.col("doc_id") * 7919)
        return d.select(
            F.col("doc_id").cast("string").alias("article_id"), "doc_id", code(89).alias("ticker"), F.left("text", F.lit(80)).alias("title"), F.substring("text", 81, 120).alias("summary"), F.col("text").alias("body_text"), F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("_rss"))).otherwise(F.col("source")).alias("source"),
            F.when(F.col("doc_id") % 11 != 0, published).alias("published_at"), published.alias("fetched_at"), F.to_date(published).alias("published_date"), mentions.alias("ticker_mentions"),
            F.concat(F.lit("HTTPS://News.Example.COM:443/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x&b=2&a="), (F.col("doc_id") % 10).cast("string"), F.lit("#top")).alias("url"),
            (F.col("doc_id") % 5 - 2).cast("int").alias("sentiment_score"), F.when(F.col("doc_id") % 5 > 2, "positive").when(F.col("doc_id") % 5 < 2, "negative").otherwise("neutral").alias("sentiment_label"),
        )

    def filings(self) -> DataFrame:
        p = self.raw("part")
        kind = F.element_at(F.array(*(F.lit(x) for x in ("Báo cáo tài chính hợp nhất Quý 1", "BCTC riêng quý II", "Giải trình chênh lệch lợi nhuận", "Consolidated financial statements 9M", "Công bố thông tin", "Annual report", "Báo cáo bán niên", "thông báo"))), (F.col("p_partkey") % 8 + 1).cast("int"))
        status = F.when(F.col("p_partkey") % 9 == 0, "failed").when(F.col("p_partkey") % 9 == 1, "skipped").when(F.col("p_partkey") % 9 == 2, None).otherwise("downloaded")
        return p.select(
            F.concat(F.lit("D"), (F.col("p_partkey") % 1500).cast("string")).alias("doc_id"), "p_partkey", F.concat(F.lit("S"), F.lpad((F.col("p_partkey") % 100 + 1).cast("string"), 5, "0")).alias("ticker"), F.concat_ws(" ", kind, (2015 + F.col("p_partkey") % 10).cast("string"), "p_name").alias("title"),
            status.alias("status"), (F.col("p_partkey") % 2 == 0).alias("qc_pass"), (F.col("p_size") * 1000).cast("long").alias("file_size"), F.concat(F.lit("https://files.example.com/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_EN.pdf").otherwise(".pdf")).alias("url_pdf"),
            F.timestamp_seconds(F.lit(1420070400) + F.col("p_partkey") * 86400).alias("published_at"), F.col("p_brand").alias("source"),
        )


_SCODE = "'S' || lpad(cast({} as varchar), 5, '0')"
#: The same views in DuckDB SQL; a view may name others.
VIEWS = {
    "trades": f"""select {_SCODE.format('l_suppkey')} as ticker, cast(l_shipdate as date) as trading_date, cast(round(cast(l_extendedprice / l_quantity as decimal(28,10)), 2) as decimal(18,2)) as unit,
        cast(l_quantity as decimal(18,2)) as quantity, l_orderkey * 8 + l_linenumber as ord, cast(l_discount as decimal(18,2)) as discount, cast(l_tax as decimal(18,2)) as tax, cast(l_extendedprice as decimal(18,2)) as amount, l_returnflag as flag from lineitem""",
    "price": """select ticker, trading_date, min_by(unit, ord)::double as open, max(unit)::double as high, min(unit)::double as low, max_by(unit, ord)::double as close, sum(quantity)::bigint as volume,
        case when min(ord) % 3 <> 0 then sum(amount)::double end as value, max(ord) as fetched from trades group by ticker, trading_date""",
    "index_price": """select case flag when 'A' then 'VNINDEX' when 'N' then 'VN30' else 'HNXINDEX' end as index_code, trading_date, min_by(unit, ord)::double as open, max(unit)::double as high, min(unit)::double as low, round(cast(sum(unit)::double / count(*) as decimal(28,10)), 2)::double as close, sum(quantity)::bigint as volume from trades group by 1, 2""",
    "listing": f"""select {_SCODE.format('s_suppkey')} as symbol, s_name as organ_name, case when r_regionkey < 2 then 'HOSE' when r_regionkey < 4 then 'hnx' else 'UPCOM' end as exchange, case when s_suppkey % 10 = 0 then 'bond' else 'Stock' end as type,
        s_suppkey as ord, n_name as industry, s_acctbal as capital from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "company": """select symbol as ticker, industry as company_type, date '1990-01-01' + ord::int as founded_date, case when ord % 5 <> 0 then capital end as charter_capital, ord * 10 as number_of_employees from listing where ord % 4 <> 0""",
    "ratio_sums": """select ticker, year(trading_date) as year, quarter(trading_date) as quarter, sum(unit)::double as u, sum(discount)::double as d, sum(tax)::double as t, sum(quantity)::double as q, sum(amount)::double as a, count(*) as n from trades group by 1, 2, 3""",
    "ratio": """select ticker, item_code, year || '-Q' || quarter as period, 'quarter' as period_type, year, quarter, case when (year + quarter) % 7 <> 0 then round(cast(v as decimal(28,10)), 4)::double end as value from (
        select ticker, year, quarter, 'trailing_eps' as item_code, u / n as v from ratio_sums union all select ticker, year, quarter, 'pe_ratio', q / n from ratio_sums union all select ticker, year, quarter, 'pb_ratio', d / n from ratio_sums
        union all select ticker, year, quarter, 'roe', t / n from ratio_sums union all select ticker, year, quarter, 'roa', (t + d) / n from ratio_sums union all select ticker, year, quarter, 'revenue', a from ratio_sums)""",
    "board": """select 'U' || lpad(cast(user_id as varchar), 5, '0') as symbol, ts as snapshot_at, event_id, event_type as exchange, round(cast(value as decimal(28,10)), 2)::double as close_price, round(cast(value - event_id % 7 as decimal(28,10)), 2)::double as bid_price_1,
        round(cast(value + event_id % 5 as decimal(28,10)), 2)::double as ask_price_1, round(cast(value + event_id % 3 - 1 as decimal(28,10)), 2)::double as high_price, round(cast(value - event_id % 4 as decimal(28,10)), 2)::double as low_price,
        event_id % 1000 as foreign_buy, event_id % 700 as foreign_sell, event_id % 1013 - 3 as volume from events""",
    "news": f"""select doc_id::varchar as article_id, doc_id, {_SCODE.format('doc_id % 89 + 1')} as ticker, left(text, 80) as title, substring(text, 81, 120) as summary, text as body_text, case when doc_id % 4 = 0 then source || '_rss' else source end as source,
        case when doc_id % 11 <> 0 then make_timestamp((788918400 + doc_id * 7919) * 1000000) end as published_at, make_timestamp((788918400 + doc_id * 7919) * 1000000) as fetched_at, cast(make_timestamp((788918400 + doc_id * 7919) * 1000000) as date) as published_date,
        list_filter([{_SCODE.format('doc_id % 97 + 1')}, case when doc_id % 3 = 0 then ' ' || {_SCODE.format('doc_id % 53 + 1')} end, case when doc_id % 5 = 0 then '' end], lambda x: x is not null) as ticker_mentions,
        'HTTPS://News.Example.COM:443/' || lang || '/' || doc_id || '/?utm_source=x&b=2&a=' || doc_id % 10 || '#top' as url, (doc_id % 5 - 2)::int as sentiment_score,
        case when doc_id % 5 > 2 then 'positive' when doc_id % 5 < 2 then 'negative' else 'neutral' end as sentiment_label from documents""",
    "filings": f"""select 'D' || p_partkey % 1500 as doc_id, p_partkey, {_SCODE.format('p_partkey % 100 + 1')} as ticker,
        ['Báo cáo tài chính hợp nhất Quý 1', 'BCTC riêng quý II', 'Giải trình chênh lệch lợi nhuận', 'Consolidated financial statements 9M', 'Công bố thông tin', 'Annual report', 'Báo cáo bán niên', 'thông báo'][(p_partkey % 8 + 1)::int] || ' ' || 2015 + p_partkey % 10 || ' ' || p_name as title,
        case p_partkey % 9 when 0 then 'failed' when 1 then 'skipped' when 2 then null else 'downloaded' end as status, p_partkey % 2 = 0 as qc_pass, (p_size * 1000)::bigint as file_size, 'https://files.example.com/' || p_partkey || case when p_partkey % 2 = 0 then '_EN.pdf' else '.pdf' end as url_pdf,
        make_timestamp((1420070400 + p_partkey * 86400) * 1000000) as published_at, p_brand as source from part""",
}


def oracle(sql: str, more: dict[str, str] | None = None) -> str:
    """``sql`` with the views that it names, and those that they name, in front."""
    known = VIEWS | (more or {})
    ordered: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in known:
            if name != own and name not in ordered and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                need(known[name], name)
                ordered.append(name)

    need(sql)
    head = ",\n".join(f"{n} as materialized ({known[n]})" for n in ordered)
    body = sql.strip()
    if not head:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    return f"with {head},\n{body[5:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"
