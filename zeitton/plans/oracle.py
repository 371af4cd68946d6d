"""The checked queries as plain SQL over the same tables, for comparison in DuckDB."""

from __future__ import annotations

from zeitton.plans.inputs import NEGATIVE, POSITIVE

SQL: dict[str, str] = {}
LABEL = {
    "D": "{d}",
    "W": "(date_trunc('week', {d}) + interval 6 day)::date",
    "M": "last_day({d})",
}
STEPS = {
    "D": "(select unnest(generate_series({a}::timestamp, {b}::timestamp, interval 1 day))::date as period_end)",
    "W": "(select unnest(generate_series({a}::timestamp, {b}::timestamp, interval 7 day))::date as period_end)",
    "M": "(select last_day(unnest(generate_series(date_trunc('month', {a}::timestamp), {b}::timestamp, "
    "interval 1 month))::date) as period_end)",
}


def label(freq: str, column: str = "o_orderdate") -> str:
    return LABEL[freq].format(d=f"{column}::date")


def spine(freq: str, a: str, b: str) -> str:
    return STEPS[freq].format(a=a, b=b)


def r6(expression: str) -> str:
    return f"round({expression} + 1e-9, 6) + 0.0"


# --- resampling -------------------------------------------------------------------------------


def resample(agg: str, freq: str) -> str:
    function = "avg" if agg == "mean" else "median"
    ends = spine(freq, "(select min(period_end) from ts)", "(select max(period_end) from ts)")
    return f"""
    with ts as (select {label(freq)} as period_end, {r6(f'{function}(o_totalprice)')} as v from orders group by 1)
    select s.period_end, ts.v as o_totalprice_{agg} from {ends} s left join ts using (period_end)"""


for _agg in ("mean", "median"):
    for _freq in "DWM":
        SQL[f"resample_{_agg}_{_freq.lower()}"] = resample(_agg, _freq)

SQL["date_range_filter"] = """
select event_id, value from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'"""

SQL["number_coercion"] = f"""
with e as (select ts::date as period_end,
    try_cast(case when event_type = 'error' then 'n/a' else value::varchar end as double) as a,
    case when event_type <> 'view' then (props::json ->> '$.k')::double end as b from events)
select period_end, {r6('avg(a)')} as a_mean, {r6('avg(b)')} as b_mean
from e where a is not null and b is not null group by 1"""

SQL["aggregate_sentiment"] = f"""
with ts as (select last_day(o_orderdate::date) as period_end, median(o_totalprice) as p, median(o_custkey::double) as c
    from orders where o_orderdate >= timestamp '1994-06-01' and o_orderdate <= timestamp '1998-08-15' group by 1),
full_ts as (select s.period_end, p, c
    from (select last_day(unnest(generate_series(timestamp '1994-06-01', timestamp '1998-07-01', interval 1 month))::date)
          as period_end) s left join ts using (period_end))
select period_end,
    {r6('last_value(p ignore nulls) over (order by period_end)')} as o_totalprice_median,
    {r6('last_value(c ignore nulls) over (order by period_end)')} as o_custkey_median
from full_ts"""


def category_series(agg: str, freq: str) -> str:
    function = "avg" if agg == "mean" else "median"
    return f"""
    with both_cats as (select o_orderpriority as category, o_orderdate, o_totalprice, o_custkey from orders
        union all select 'all', o_orderdate, o_totalprice, o_custkey from orders)
    select category, {label(freq)} as period_end, {r6(f'{function}(o_totalprice)')} as o_totalprice_{agg},
        {r6(f'{function}(o_custkey::double)')} as o_custkey_{agg}
    from both_cats group by 1, 2"""


SQL["category_series_mean"] = category_series("mean", "M")
SQL["category_series_median"] = category_series("median", "W")

SQL["category_series_bounded"] = "\nunion all\n".join(
    f"""select '{how}' as how, '{agg}' as agg, category, period_end, v from (
    with both_cats as (select o_orderpriority as category, o_orderdate, o_totalprice from orders
        union all select 'all', o_orderdate, o_totalprice from orders),
    ts as (select category, last_day(o_orderdate::date) as period_end, {'avg' if agg == 'mean' else 'median'}(o_totalprice) as v
        from both_cats where o_orderdate >= timestamp '1994-06-01' and o_orderdate <= timestamp '2003-08-15' group by 1, 2),
    grid as (select category, last_day(unnest(generate_series(timestamp '1994-06-01', timestamp '2003-07-01', interval 1 month))::date)
        as period_end from (select distinct category from ts)),
    full_ts as (select category, period_end, v from grid left join ts using (category, period_end))
    select category, period_end, {r6("last_value(v ignore nulls) over (partition by category order by period_end)" if how == 'ffill' else 'v')} as v
    from full_ts {'where v is not null' if how == 'drop' else ''})"""
    for how in ("fill", "ffill", "drop") for agg in ("mean", "median")
)

# --- gaps -------------------------------------------------------------------------------------

_BOUNDED = f"""
with ts as (select o_orderstatus, o_orderdate::date as period_end, {r6('avg(o_totalprice)')} as v
    from orders where o_orderdate >= timestamp '1994-12-20' and o_orderdate <= timestamp '2001-08-10' group by 1, 2),
full_ts as (select k.o_orderstatus, s.period_end, ts.v
    from (select distinct o_orderstatus from ts) k
    cross join {spine('D', "'1994-12-20'", "'2001-08-10'")} s
    left join ts on ts.o_orderstatus = k.o_orderstatus and ts.period_end = s.period_end)
"""
SQL["sketched_medians"] = """
with both_cats as (select o_orderpriority as category, o_orderdate from orders union all select 'all', o_orderdate from orders)
select category, last_day(o_orderdate::date) as period_end, count(*) as n, true as near_the_middle from both_cats group by 1, 2"""
SQL["spine_reindex"] = _BOUNDED + "select o_orderstatus, period_end, v as o_totalprice_mean from full_ts"
SQL["ffill"] = _BOUNDED + """select o_orderstatus, period_end,
    last_value(v ignore nulls) over (partition by o_orderstatus order by period_end) as o_totalprice_mean from full_ts"""
SQL["drop_missing"] = _BOUNDED + (
    "select o_orderstatus, period_end, v as o_totalprice_mean from full_ts where v is not null"
)

SQL["observed_spine"] = f"""
with ts as (select o_orderstatus, o_orderpriority, {label('W')} as period_end, {r6('avg(o_totalprice)')} as v
    from orders group by 1, 2, 3),
ends as (select o_orderstatus, o_orderpriority, min(period_end) as a, max(period_end) as b from ts group by 1, 2),
full_ts as (select o_orderstatus, o_orderpriority,
    unnest(generate_series(a::timestamp, b::timestamp, interval 7 day))::date as period_end from ends)
select f.o_orderstatus, f.o_orderpriority, f.period_end, ts.v as o_totalprice_mean from full_ts f
left join ts using (o_orderstatus, o_orderpriority, period_end)"""

SQL["period_spines"] = """
with e as (select min(o_orderdate::date) as a, max(o_orderdate::date) as b from orders),
d as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from e)
select 'D' as freq, day as period_end from d
union all select 'W', day from d where isodow(day) = 7
union all select 'M', day from d where last_day(day) = day"""

# --- correlograms -----------------------------------------------------------------------------

_WEEKLY = f"""
src as (select o_orderstatus as k, {label('W')} as period_end, avg(o_totalprice) as x from orders group by 1, 2),"""


def centred(lags: int) -> str:
    """From ``src(k, period_end, x)`` to ``sums(k, lag, s)`` and ``sizes(k, n)`` by a self-join on position."""
    return f"""
    pos as (select k, row_number() over (partition by k order by period_end) as i,
        x - avg(x) over (partition by k) as d, x from src where x is not null),
    sizes as (select k, count(*) as n, min(x) < max(x) as varies from pos group by 1),
    lags as (select unnest(range(0, {lags} + 1)) as lag),
    sums as (select a.k, l.lag, sum(a.d * b.d) as s from pos a, lags l, pos b
        where a.k = b.k and a.i = b.i + l.lag group by 1, 2),"""


def partials(lags: int) -> str:
    """Durbin-Levinson as a recursion over lags, giving ``found(k, lag, a)``."""
    return f"""
    cov as (select k, n, list(s / (n - lag) order by lag) as r from sums join sizes using (k) where varies group by 1, 2),
    rec as (
        select k, n, r, 0 as lag, []::double[] as phi, r[1] as v, 1.0::double as a from cov
        union all
        select k, n, r, lag + 1,
            list_append(list_transform(range(1, lag + 1), lambda j: phi[j] - next_a * phi[lag + 1 - j]), next_a),
            v * (1 - next_a * next_a), next_a
        from (select *, (r[lag + 2] - coalesce(list_sum(list_transform(range(1, lag + 1),
                lambda j: phi[j] * r[lag + 2 - j])), 0)) / v as next_a from rec)
        where lag + 1 <= {lags} and lag + 1 < n / 2),
    found as (select k, lag, a from rec)"""


SQL["acf"] = f"""
with {_WEEKLY} {centred(40)}
zero as (select k, s as s0 from sums where lag = 0)
select k as o_orderstatus, lag, {r6('s / s0')} as acf from sums join zero using (k)"""

SQL["acf_of_segments"] = SQL["acf"]
SQL["pacf"] = f"""
with recursive {_WEEKLY} {centred(40)} {partials(40)}
select k as o_orderstatus, lag::bigint as lag, {r6('a')} as pacf from found"""

SQL["lag_pairs"] = f"""
with {_WEEKLY} {centred(5)}
done as (select 1)
select a.k as o_orderstatus, l.lag, a.i as at, {r6('a.x')} as x, {r6('b.x')} as lagged
from pos a, lags l, pos b where a.k = b.k and a.i = b.i + l.lag"""

_BY_CATEGORY = """
both_cats as (select o_orderpriority as category, o_orderdate, o_totalprice, o_custkey from orders
    union all select 'all', o_orderdate, o_totalprice, o_custkey from orders),
src as (select category || '/' || m as k, last_day(o_orderdate::date) as period_end,
        avg(case m when 'o_totalprice_mean' then o_totalprice else o_custkey end) as x
    from both_cats, (values ('o_totalprice_mean'), ('o_custkey_mean')) t(m) group by 1, 2),"""
SQL["acf_by_category"] = f"""
with recursive {_BY_CATEGORY} {centred(24)} {partials(24)},
zero as (select k, s as s0 from sums where lag = 0)
select split_part(sums.k, '/', 1) as category, split_part(sums.k, '/', 2) as measure, sums.lag,
    {r6('s / s0')} as acf, {r6('a')} as pacf
from sums join zero using (k) left join found on found.k = sums.k and found.lag = sums.lag"""

SQL["trend_long"] = f"""
with ts as (select last_day(o_orderdate::date) as period_end, avg(o_totalprice) as p, avg(o_custkey) as c
    from orders group by 1),
full_ts as (select s.period_end, p, c
    from {spine('M', "(select min(period_end) from ts)", "(select max(period_end) from ts)")} s
    left join ts using (period_end))
select period_end, 'o_totalprice_mean' as measure, {r6('p')} as value from full_ts
union all select period_end, 'o_custkey_mean', {r6('c')} from full_ts"""

SQL["series_head"] = f"select * from ({resample('median', 'M')}) order by period_end limit 10"

_EXAMPLE = """
rows_in as (select * from orders where o_orderstatus = 'F'
    and o_orderdate >= timestamp '1990-01-01' and o_orderdate <= timestamp '2002-03-01'),
src as (select m as k, last_day(o_orderdate::date) as period_end,
        median(case m when 'o_totalprice_median' then o_totalprice else o_custkey::double end) as x
    from rows_in, (values ('o_totalprice_median'), ('o_custkey_median')) t(m)
    where last_day(o_orderdate::date) <= date '2002-02-28' group by 1, 2),"""
SQL["worked_example"] = f"""
with recursive {_EXAMPLE} {centred(53)} {partials(53)},
zero as (select k, s as s0 from sums where lag = 0)
select sums.k as measure, sums.lag, {r6('s / s0')} as acf, {r6('a')} as pacf
from sums join zero using (k) left join found on found.k = sums.k and found.lag = sums.lag"""

# --- polarity and dates -----------------------------------------------------------------------

_POLARITY = """
with scored as (select event_id, ts, event_type, (props::json ->> '$.k')::int as k,
    case event_type when 'click' then (props::json ->> '$.k')::int - 0.25::double
        when 'view' then -((props::json ->> '$.k')::int + 0.5::double) end as polarity from events)
"""
SQL["polarity_json"] = _POLARITY + f"select event_id, {r6('polarity')} as polarity from scored"
SQL["polarity_series"] = _POLARITY + f""",
ts as (select event_type, ts::date as period_end, median(polarity) as v from scored
    where polarity is not null group by 1, 2),
ends as (select event_type, min(period_end) as a, max(period_end) as b from ts group by 1),
full_ts as (select event_type,
    unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as period_end from ends)
select event_type, period_end, {r6('v')} as polarity_median from full_ts left join ts using (event_type, period_end)"""

SQL["parse_german_date"] = """
select event_id,
    case when event_type in ('click', 'view') then strftime(ts, '%Y-%m-%d %H:%M') end as strict,
    case when event_type in ('click', 'view') then strftime(ts, '%Y-%m-%d %H:%M')
        when event_type = 'signup' then strftime(ts, '%Y-%m-%d 00:00') end as lenient
from events"""

# --- categories -------------------------------------------------------------------------------

SQL["infer_category_pages"] = """
select page_id, case when lower(url) like '%/en/%' then 'en' when lower(url) like '%/es/%' then 'es'
    when lower(url) like '%/de/%' then 'de' else 'other' end as category from pages"""
_CATEGORY = "case lang when 'de' then 'inland' when 'en' then 'ausland' when 'fr' then 'wirtschaft' else 'other' end"
SQL["infer_category_articles"] = f"select doc_id, {_CATEGORY} as category from documents"
SQL["category_sizes"] = f"select {_CATEGORY} as inferred_category, count(*) as n from documents group by 1"

_ARTICLES = """
turns as (select conv_id, max(text) filter (turn = 0) as headline, max(text) filter (turn = 1) as short_headline,
    max(text) filter (turn = 2) as short_text from conversations group by 1),
articles as (select doc_id, lang, source,
    date '2023-01-01' + (n_chars % 700)::int as day,
    strftime(date '2023-01-01' + (n_chars % 700)::int, '%Y-%m-%d') as date_api,
    ascii(source) as page_api, headline, short_headline, short_text,
    '/' || case lang when 'de' then 'Inland' when 'en' then 'ausland' when 'fr' then 'wirtschaft' else 'sport' end
        || '/a-' || md5(text) || '.html' as link,
    text as "articleBody"
    from documents left join turns on conv_id = doc_id % (select max(conv_id) + 1 from conversations))"""
SQL["category_filter"] = f"""
with {_ARTICLES} select doc_id, link, 'inland' as inferred_category from articles where lang = 'de'"""

# --- chunks and scores ------------------------------------------------------------------------

SQL["chunk_counts"] = r"""
select doc_id, len(regexp_extract_all(text, '\S+')) as n_words,
    ceil(len(regexp_extract_all(text, '\S+')) / 200)::bigint as n_chunks,
    len(regexp_extract_all(text, '\S+')) > 0 as has_text
from documents"""


def chunk_rows(source: str, key: str, text: str) -> str:
    """Rows ``(key, chunk_no, n_chunks, chunk)`` by slicing the list of words."""
    return rf"""
    select {key}, chunk_no, n_chunks, case when n_chunks = 1 then {text}
        else array_to_string(w[chunk_no * 200 + 1 : chunk_no * 200 + 200], ' ') end as chunk
    from (select *, unnest(range(0, n_chunks)) as chunk_no
        from (select *, ceil(len(w) / 200)::bigint as n_chunks
            from (select *, regexp_extract_all({text}, '\S+') as w from {source})))"""


SQL["chunk_text"] = f"select doc_id, chunk_no, chunk from ({chunk_rows('documents', 'doc_id', 'text')})"

_WORDS = {n: ", ".join(f"'{w}'" for w in words) for n, words in (("p", POSITIVE), ("n", NEGATIVE))}
_STRONGEST = (
    "case when positive >= negative and positive >= neutral then 'positive' "
    "when negative >= neutral then 'negative' else 'neutral' end"
)


def scored_chunks(source: str, key: str, text: str) -> str:
    return rf"""
    select {key}, chunk_no, n_chunks, p / t as positive, n / t as negative, (t - p - n) / t as neutral
    from (select {key}, chunk_no, n_chunks, greatest(len(w), 1) as t,
            len(list_filter(w, lambda x: x in ({_WORDS['p']}))) as p, len(list_filter(w, lambda x: x in ({_WORDS['n']}))) as n
        from (select {key}, chunk_no, n_chunks, regexp_extract_all(lower(chunk), '\p{{L}}+') as w
            from ({chunk_rows(source, key, text)})))"""


def scored_texts(source: str, key: str, text: str) -> str:
    """Rows ``(key, n_chunks, positive, negative, neutral)`` with the combined probabilities."""
    return f"""
    select {key}, n_chunks, case when n_chunks = 1 or t = 0 then positive else positive / t end as positive,
        case when n_chunks = 1 or t = 0 then negative else negative / t end as negative,
        case when n_chunks = 1 or t = 0 then neutral else neutral / t end as neutral
    from (select *, positive + negative + neutral as t
        from (select {key}, n_chunks, avg(positive) as positive, avg(negative) as negative, avg(neutral) as neutral
            from ({scored_chunks(source, key, text)}) group by all))"""


_THREE = ", ".join(f"{r6(c)} as {c}" for c in ("positive", "negative", "neutral"))
SQL["lexicon_chunk_scores"] = f"""
select doc_id, chunk_no, {_STRONGEST} as label, {_THREE} from ({scored_chunks('documents', 'doc_id', 'text')})"""
SQL["doc_sentiment"] = f"""
select doc_id, {_STRONGEST} as category, {_THREE} from ({scored_texts('documents', 'doc_id', 'text')})"""
SQL["model_sentiment"] = SQL["doc_sentiment"]
SQL["chunk_means"] = f"""
select doc_id, n_chunks, {_STRONGEST} as category, {_THREE} from ({scored_texts('documents', 'doc_id', 'text')})"""
SQL["score_json_round_trip"] = f"""
select doc_id, {r6('positive - negative')} as polarity from ({scored_texts('documents', 'doc_id', 'text')})"""
SQL["streamed_scores"] = f"""
select doc_id, {_STRONGEST} as category, {r6('positive - negative')} as polarity
from ({scored_texts('documents', 'doc_id', 'text')})"""
SQL["scored_once"] = SQL["streamed_scores"]
SQL["streamed_counts"] = f"""
select 'text' as field, {_STRONGEST} as category, count(*) as n
from ({scored_texts('documents', 'doc_id', 'text')}) group by 1, 2"""

_FIELDS = ("headline", "short_headline", "short_text", "articleBody")
_SCORED = f"""{_ARTICLES},
long as (select doc_id, field, coalesce(text, '') as text from articles unpivot include nulls (text for field in
    ({', '.join(f'"{f}"' for f in _FIELDS)}))),
scored as (select doc_id, field, {_STRONGEST} as category, positive - negative as polarity
    from ({scored_texts('(select doc_id, field, text from long)', 'doc_id, field', 'text')})),
results as (select doc_id, field, coalesce(category, 'neutral') as category, coalesce(polarity, 0) as polarity
    from long left join scored using (doc_id, field))"""

_WIDE_CATEGORY = ", ".join(
    f"max(case when field = '{f}' then category end) as \"{f}_sentiment_category\"" for f in _FIELDS
)
_WIDE_POLARITY = ", ".join(
    f"{r6(f'''max(case when field = '{f}' then polarity end)''')} as \"{f}_polarity\"" for f in _FIELDS
)
SQL["field_sentiment_wide"] = f"""
with {_SCORED} select doc_id, {_WIDE_CATEGORY}, {_WIDE_POLARITY} from results group by 1"""
SQL["sentiment_counts"] = f"with {_SCORED} select field, category, count(*) as n from results group by 1, 2"
SQL["counts_with_seed"] = SQL["sentiment_counts"]
SQL["clean_articles"] = f"""
with {_SCORED}, wide as (select doc_id, {_WIDE_POLARITY} from results group by 1)
select wide.*, link, headline, strftime(day, '%Y-%m-%d 09:05') as date from wide join articles using (doc_id)"""
SQL["cleaned_tsv_loaded"] = f"""
with {_SCORED}, wide as (select doc_id, {_WIDE_POLARITY} from results group by 1)
select wide.* exclude (doc_id), link, headline, {_CATEGORY} as inferred_category, strftime(day, '%Y-%m-%d 09:05') as date
from wide join articles using (doc_id)"""
SQL["observed_rejects"] = """
select count(*) as rows, count(*) filter (where source like '%7') as rejected, 0::bigint as failed from documents"""
SQL["rejected_dates"] = """
select count(*) filter (where source like '%7') as rejected, count(*) as rows from documents"""

_ARTICLE_POLARITY = f"""{_SCORED},
dated as (select field, polarity, day, {_CATEGORY} as category from results join articles using (doc_id))"""
SQL["article_polarity_series"] = f"""
with {_ARTICLE_POLARITY},
both_cats as (select * from dated union all select field, polarity, day, 'all' from dated)
select category, last_day(day) as period_end,
    {r6("median(polarity) filter (where field = 'articleBody')")} as "articleBody_polarity_median",
    {r6("median(polarity) filter (where field = 'headline')")} as headline_polarity_median
from both_cats group by 1, 2"""
SQL["article_correlogram"] = f"""
with recursive {_ARTICLE_POLARITY},
src as (select field || '_polarity_median' as k, {label('W', 'day')} as period_end, median(polarity) as x from dated
    where category = 'ausland' and field in ('articleBody', 'headline') and day < date '2024-11-30'
        and {label('W', 'day')} <= date '2024-11-24' group by 1, 2),
{centred(20)} {partials(20)},
zero as (select k, s as s0 from sums where lag = 0)
select sums.k as measure, sums.lag, {r6('s / s0')} as acf, {r6('a')} as pacf
from sums join zero using (k) left join found on found.k = sums.k and found.lag = sums.lag"""

# --- calendars and worklists ------------------------------------------------------------------

SQL["month_groups"] = """
with d as (select distinct o_orderdate::date as day from orders)
select year(day) as year, month(day) as month, strftime(min(day), '%m.%Y') as label,
    string_agg(strftime(day, '%d'), ',' order by day) as days from d group by 1, 2"""
SQL["archive_urls"] = """
with e as (select min(o_orderdate::date)::timestamp as a, max(o_orderdate::date)::timestamp as b from orders),
d as (select unnest(generate_series(a, b, interval 1 day))::date as day from e)
select day, 'https://news.example.org/archiv?datum=' || strftime(day, '%Y-%m-%d') || '&pageIndex=1' as url from d"""

_STATUS = """
flags as (select o_orderdate::date as day, left(o_orderpriority, 1)::bigint as page,
    count(*) filter (where o_orderstatus <> 'P') as n_links,
    bool_or(o_totalprice < 3000) as monthly_summary, bool_or(o_totalprice > 490000) as error
    from orders group by 1, 2),
work as (select later as day, case when later = day then page else 1 end as start_page
    from (select day, page, unnest(generate_series(day::timestamp, last_day(day)::timestamp, interval 1 day))::date as later
        from flags where error)),
kept as (select f.* from flags f where f.page = (select count(distinct g.page) from flags g
    where g.day = f.day and g.page between 1 and f.page and not g.error and g.n_links > 0))"""
SQL["backfill_days"] = f"with {_STATUS} select day, start_page from work"
SQL["start_page_filter"] = f"""
with {_STATUS} select f.day, f.page, f.n_links from flags f
where exists (select 1 from work w where w.day = f.day and f.page >= w.start_page)"""
SQL["page_takewhile"] = f"with {_STATUS} select day, page, n_links from kept"
SQL["page_gap_stop"] = f"""
with {_STATUS}, left_over as (select * from flags where not (day(day) % 3 = 0 and page = 2))
select day, page, n_links from left_over f where f.page = (select count(distinct g.page) from left_over g
    where g.day = f.day and g.page <= f.page and not g.error and g.n_links > 0)"""
SQL["month_cutoff"] = f"""
with {_STATUS} select day, page, n_links from kept k where not exists (select 1 from kept s
    where s.monthly_summary and s.n_links > 0 and s.day < k.day and last_day(s.day) = last_day(k.day))"""
SQL["missing_days"] = """
with e as (select min(o_orderdate::date)::timestamp as a, max(o_orderdate::date)::timestamp as b from orders),
d as (select unnest(generate_series(a, b, interval 1 day))::date as day from e)
select day from d where day not in (select o_orderdate::date from orders where o_orderstatus = 'F')"""
SQL["failed_day_lines"] = """
select ts::date as day, case event_type when 'click' then 2::bigint when 'view' then 3::bigint end as page,
    case event_type when 'click' then 'timeout;x' end as rest, count(*) as n
from events where event_type in ('click', 'view', 'signup') group by 1, 2, 3"""

# --- links and dataset ------------------------------------------------------------------------

_LINKS = """
hrefs as (select page_id, unnest(h) as link, generate_subscripts(h, 1) - 1 as pos
    from (select page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) as h from pages))"""
SQL["page_links"] = f"with {_LINKS} select page_id, pos::bigint as pos, link from hrefs"
SQL["relative_links"] = f"""
with {_LINKS}, both_kinds as (select page_id, pos::bigint as pos, link from hrefs
    union all select page_id, -1, url from pages)
select page_id, pos, link, 'https://news.example.org' || link as url from both_kinds where not starts_with(link, 'http')"""

SQL["links_from_json_lines"] = f"""
with {_ARTICLES} select date_api, page_api::bigint as page_api, strftime(day, '%d.%m.%Y • 09:05 Uhr') as date,
    headline, short_headline, short_text, link from articles where lang = 'en'"""
SQL["dedup_links"] = f"""
with {_ARTICLES} select doc_id, date_api, page_api::bigint as page_api, headline, link, "articleBody" from articles
qualify row_number() over (partition by link order by date_api, page_api, doc_id) = 1"""
SQL["tsv_round_trip"] = f"""
with {_ARTICLES} select date_api, page_api::bigint as page_api, headline, short_text, link, "articleBody",
    source || chr(9) || '"x"' || chr(10) || ' y ' as description, '["' || lang || '","' || source || '"]' as taglist
    from articles"""
SQL["json_lines_round_trip"] = f"""
with {_ARTICLES} select date_api, page_api::bigint as page_api, strftime(day, '%d.%m.%Y • 09:05 Uhr') as date,
    headline, short_headline, short_text, link from articles"""
SQL["parquet_sink"] = f"""
with {_ARTICLES} select doc_id, date_api, link, "articleBody" from articles"""
SQL["page_keys_from_url"] = """
select 'archive' as kind, date '2024-01-01' + (page_id % 300)::int as day,
    case when page_id % 3 = 0 then 1 else page_id % 7 + 1 end as page, null as link, md5(html) as digest
from pages where page_id % 2 = 0
union all select 'archive_as_article', null, null, '/archiv', md5(html) from pages where page_id % 2 = 0
union all select 'article', null, null, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), md5(html)
from pages where page_id % 2 = 1 and regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) <> ''"""
SQL["dataset_statistics"] = f"""
with {_ARTICLES} select count(*) as articles, count(distinct date_api) as days,
    count(distinct link) as unique_articles from articles"""
SQL["statistics_by_batches"] = f"""
with {_ARTICLES}, first_batch as (select link, min(doc_id % 4) as batch from articles group by 1),
per_batch as (select batch, count(*) as n from first_batch group by 1)
select count(*) as articles, count(distinct date_api) as days, count(distinct link) as unique_articles,
    (select string_agg(n::varchar, ',' order by batch) from per_batch) as new_links from articles"""
SQL["sorted_tsv"] = f"""
with {_ARTICLES} select date_api, page_api::bigint as page_api, link, true as in_order from articles"""
SQL["sorted_articles"] = f"with {_ARTICLES} select doc_id, date_api, link from articles order by date_api, page_api, link"
SQL["rows_after_offset"] = f"""
with {_ARTICLES} select doc_id, date_api, link from articles order by date_api, doc_id offset 150"""
SQL["resume_antijoin"] = """
select doc_id, text from documents where doc_id not in (select doc_id from labels)"""
SQL["resume_bucketed"] = SQL["resume_antijoin"]
SQL["union_old_new"] = """
select doc_id, lang, (select max(quality)::bigint from labels l where l.doc_id = d.doc_id) as quality from documents d"""

# --- HTML -------------------------------------------------------------------------------------

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def visible(html: str) -> str:
    """Text nodes of markup: split at tags, references resolved, stripped, joined with nothing."""
    node = r"regexp_replace(x, '&amp(;|$)', '&', 'g')"
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("nbsp", " ")):
        node = node.replace("(x,", f"(replace(x, '&{name};', '{character}'),", 1) if "(x," in node else node.replace(
            "(replace(x,", f"(replace(replace(x, '&{name};', '{character}'),", 1
        )
    strip = r"regexp_replace({n}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')".format(n=node)
    return f"array_to_string(list_transform(regexp_split_to_array({html}, '<[A-Za-z/!?][^>]*>'), lambda x: {strip}), '')"


_CLEAN = f"clean as (select page_id, regexp_replace(html, '{_HIDDEN}', '<!>', 'g') as html from pages)"
SQL["page_headline"] = f"""
with {_CLEAN} select page_id, {visible("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as h1,
    {visible("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title from clean"""
SQL["text_strip"] = f"with {_CLEAN} select page_id, {visible('html')} as text from clean"

_LINES = r"""
lines as (select doc_id, lang, n_chars, unnest(t) as line, generate_subscripts(t, 1) - 1 as i
    from (select *, string_split(text, chr(10)) as t from documents)),
parts as (select *, regexp_extract(line, '\S+(?:\s+\S+){0,2}') as start from lines)"""
_PAGES = """
placed as (select doc_id, lang, lang = 'de' and n_chars % 40 = 0 as summary, doc_id // 10 as number, doc_id % 10 as slot,
    date '2024-01-01' + (doc_id // 10 % 1000000)::int as day, doc_id // 10000000 as cycle from documents),
pages_in as (select doc_id, day, summary, false as bare, false as error,
    slot + 1 + 10 * cycle + (number % 4 > 0 and (slot >= 7 or cycle >= 1))::int as page from placed
    union all select null, day, false, true, number % 4 = 3, 8 from placed where slot = 7 and cycle = 0 and number % 2 = 1)"""
_TEASERS = f"""{_LINES}, {_PAGES},
teasers as (select doc_id, day, i::bigint as position, strftime(day, '%Y-%m-%d') as date_api, page as page_api,
    case when parts.lang = 'es' then strftime(day, '%Y-%m-%d') else '01.12.2024 • 09:05 Uhr' end as date,
    trim(start) || trim(substr(line, len(start) + 1)) as headline, trim(start) as short_headline,
    trim(line) as short_text, '/x/' || i as link from parts join pages_in using (doc_id))"""
SQL["archive_teasers"] = f"with {_TEASERS} select teasers.* exclude (day) from teasers"


def walked(starts: str, begin: str = "", more: str = "") -> str:
    """Teasers that a run reaches which begins each day of ``starts(day, first)`` at that page."""
    return f"""{begin}
begun as (select p.*, first from pages_in p join ({starts}) using (day) where page >= first),
met as (select * from begun b where not exists (select 1 from begun g where g.day = b.day and g.page <= b.page and g.bare)
    and page - first + 1 = (select count(distinct g.page) from begun g where g.day = b.day and g.page <= b.page)),
cuts as (select last_day(day) as month, min(day) as cut from met where summary group by 1)
select {more}t.* exclude (doc_id, day, position) from teasers t join met using (doc_id) left join cuts on month = last_day(t.day)
where cut is null or t.day <= cut"""


SQL["collect_listings"] = f"with {_TEASERS}, {walked('select distinct day, 1 as first from pages_in')}"
SQL["collect_after_listings"] = f"with {_TEASERS}, " + walked(
    "select later as day, min(case when later = day then page else 1 end) as first from (select day, page, "
    "unnest(generate_series(day::timestamp, last_day(day)::timestamp, interval 1 day))::date as later "
    "from pages_in where doc_id % 290 = 145) group by 1"
)
SQL["recollected_months"] = f"""
with {_TEASERS},
work as (select later as day, min(case when later = day then page else 1 end) as first from (select day, page,
    unnest(generate_series(day::timestamp, last_day(day)::timestamp, interval 1 day))::date as later
    from pages_in where doc_id % 290 = 145) group by 1),
earlier as ({walked("select distinct day, 1 as first from pages_in where day <= date '2024-01-20'", "with ", "t.day as old_day, ")}),
later as ({walked("select day, first from work", "with ")})
select e.* exclude (old_day) from earlier e left join work w on old_day = w.day where first is null or page_api < first
union all select * from later"""
SQL["streamed_listings"] = SQL["streamed_listings_split"] = SQL["collect_listings"]
SQL["monthly_summary_flag"] = f"""
with {_PAGES} select day, page, summary as monthly_summary, error,
    case when bare then 0 else len(string_split(text, chr(10))) end as n_links from pages_in left join documents using (doc_id)"""
SQL["jsonld_article"] = """
select '/d/' || doc_id as link,
    case when lang <> 'es' then text end as "articleBody",
    case lang when 'de' then '2024-01-01T08:00:00' when 'es' then null else '2024-01-02T08:00:00' end as "datePublished",
    case when lang <> 'es' then '2024-01-01T08:00:00' end as date_published,
    case when lang <> 'es' then '2024-01-02T08:00:00' end as date_modified,
    case when lang <> 'es' then '' end as description,
    case when lang <> 'es' then lang || '|' || source end as taglist,
    case when lang <> 'es' then source end as author_names,
    case when lang <> 'es' then source end as author,
    lang <> 'es' as has_article
from documents"""
SQL["article_label"] = "select doc_id, source as label from documents"
SQL["fetch_status"] = """
select case when lang = 'es' then 'no_article' else 'article' end as status, count(*) as n from documents group by 1"""
SQL["listing_article_join"] = """
select doc_id, '/d/' || doc_id as link, source as label, text as "articleBody" from documents where lang <> 'es'"""
