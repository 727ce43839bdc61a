"""ANSI SQL for each registered query, over the driver's tables."""

from __future__ import annotations

from rankmill.functions.projection import series

RESULTS = """
results as (
  select cast(extract(year from l_shipdate) as integer) as year, s_name as kommun,
    lpad(cast(s_suppkey as varchar), 6, '0') as kommun_kod, n_name as lan,
    lpad(cast(n_nationkey as varchar), 2, '0') as lan_kod,
    l_returnflag as huvudman_typ, 'S' || cast(l_linenumber as varchar) as subject,
    count(*) as n, cast(sum(cents) as bigint) as cents,
    cast(cast(sum(cents) as bigint) // count(*) as double) as total,
    cast(cast(sum(case when l_linestatus = 'F' then cents end) as bigint)
      // nullif(count(case when l_linestatus = 'F' then 1 end), 0) as double) as f,
    cast(cast(sum(case when l_linestatus = 'O' then cents end) as bigint)
      // nullif(count(case when l_linestatus = 'O' then 1 end), 0) as double) as m
  from (select *, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem) l
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by 1, 2, 3, 4, 5, 6, 7)"""

RAW = RESULTS + """,
raw as (
  select concat_ws(';', kommun, kommun_kod, lan, lan_kod, huvudman_typ, subject,
      case when n < 2 then '..' when n % 5 = 0 then '~100'
        else cast(cast(floor(cents / 10) as bigint) % 100 as varchar) || ',' || cast(cents % 10 as varchar) end,
      cast(cast(floor(cents / 100000) as bigint) as varchar) || ' ' ||
        lpad(cast(cast(floor(cents / 100) as bigint) % 1000 as varchar), 3, '0')) as raw_line,
    'results ' || cast(year as varchar) || ' Kommun.csv' as source_file
  from results
  union all select 'Kommun;Kommun-kod;' || s_name, 'results 1995 Kommun.csv' from supplier
  union all select 'Valt år: ' || s_name, 'other 1996.csv' from supplier),
data as (
  select * from raw where raw_line like '%;%' and raw_line not like 'Kommun;%'
    and raw_line not like 'Valt år:%' and raw_line not like 'Statistik%')"""

PARSED = RAW + """,
parsed as (
  select cast(regexp_extract(source_file, '([0-9]{4})', 1) as integer) as lasar_start,
    p[1] as kommun, p[2] as kommun_kod, p[3] as lan, p[4] as lan_kod, p[5] as huvudman_typ,
    p[6] as amne, p[7] as andel, p[8] as antal, source_file
  from (select str_split(raw_line, ';') as p, source_file from data where source_file like 'results%') t
  where p[6] in ('S1', 'S2', 'S3', 'S4', 'S5', 'S6'))"""

CHOICE = RESULTS + """,
base as (
  select year, kommun, lan, huvudman_typ, subject, total, f, m, f - m as gap from results),
grain as (
  select * from base
  union all
  select year, kommun, lan, huvudman_typ, 'ALL', round(avg(total), 4), round(avg(f), 4), round(avg(m), 4),
    round(avg(f), 4) - round(avg(m), 4)
  from base group by 1, 2, 3, 4),
choice as (
  select kommun, lan, year, subject, huvudman_typ, score,
    case when score >= 90 then 'Top 10%' when score >= 50 then 'Middle' else 'Bottom 50%' end as performance_bucket,
    rank_sweden, rank_lan, total as betygspoang_totalt, f as betygpoang_flickor, m as betygpoang_pojkar,
    gap as betygpoang_gap_f_minus_m
  from (
    select *,
      round(100.0 * cume_dist() over (partition by year, subject, huvudman_typ order by total), 1) as score,
      dense_rank() over (partition by year, subject, huvudman_typ order by total desc) as rank_sweden,
      dense_rank() over (partition by year, subject, huvudman_typ, lan order by total desc) as rank_lan
    from grain) t)"""

TREND = CHOICE + """,
trend as (
  select * exclude (score_prev_year, rank_sweden_prev_year, rank_lan_prev_year),
    score_prev_year, rank_sweden_prev_year, rank_lan_prev_year,
    score - score_prev_year as score_change_yoy,
    rank_sweden_prev_year - rank_sweden as rank_sweden_change_yoy,
    rank_lan_prev_year - rank_lan as rank_lan_change_yoy,
    case when score_prev_year is null then 'No previous year'
      when score - score_prev_year >= 2 then 'Improving'
      when score - score_prev_year <= -2 then 'Declining' else 'Stable' end as trend_label
  from (
    select *,
      lag(score) over w as score_prev_year,
      lag(rank_sweden) over w as rank_sweden_prev_year,
      lag(rank_lan) over w as rank_lan_prev_year
    from choice window w as (partition by kommun, subject, huvudman_typ order by year)) t)"""

SERIES = TREND + """,
series as (
  select year, subject as series, round(avg(score), 4) as score from trend
  where year < (select max(year) from trend) group by 1, 2)"""

RANKED = RESULTS + """,
means as (
  select year as lasar_start, lan, lan_kod, huvudman_typ,
    case when subject <= 'S3' then 'low' else 'high' end as amne, kommun, kommun_kod,
    round(avg(total), 4) as avg_total, round(avg(f), 4) as avg_flickor, round(avg(m), 4) as avg_pojkar,
    round(avg(f - m), 4) as avg_gap_f_minus_m, count(*) as n_rows
  from results group by 1, 2, 3, 4, 5, 6, 7),
ranked as (
  select *, round(pct_in_sweden * 100, 1) as score_0_100 from (
    select *,
      dense_rank() over (partition by lasar_start, huvudman_typ, amne order by avg_total desc) as rank_in_sweden,
      count(*) over (partition by lasar_start, huvudman_typ, amne) as n_kommun_sweden,
      percent_rank() over (partition by lasar_start, huvudman_typ, amne order by avg_total) as pct_in_sweden,
      dense_rank() over (partition by lasar_start, huvudman_typ, amne, lan_kod order by avg_total desc) as rank_in_lan,
      count(*) over (partition by lasar_start, huvudman_typ, amne, lan_kod) as n_kommun_in_lan,
      percent_rank() over (partition by lasar_start, huvudman_typ, amne, lan_kod order by avg_total) as pct_in_lan
    from means) t)"""

SHARE = """
pupils as (
  select cast(extract(year from l_shipdate) as integer) as year, s_name as kommun, n_name as lan,
    l_linestatus as huvudman_typ, cast(sum(cast(l_quantity as bigint)) as bigint) as n_students
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by 1, 2, 3, 4)"""

SHARES = SHARE + """,
shares as (
  select p.*, t.n_total,
    case when t.n_total = 0 then 0.0e0 else cast(p.n_students as double) / t.n_total end as share
  from pupils p join (
    select year, kommun, lan, cast(sum(n_students) as bigint) as n_total from pupils group by 1, 2, 3) t
    on p.year = t.year and p.kommun = t.kommun and p.lan = t.lan)"""


def _top_shares(year: int) -> str:
    return SHARES + f""",
chosen as (select * from shares where year = {year} and huvudman_typ in ('O', 'F')),
top as (
  select * from chosen where kommun in (
    select kommun from chosen group by kommun order by sum(n_students) desc, kommun limit 10))"""


WEIGHED = """
weighed as (
  select l_linestatus as kon, l_returnflag, cast(l_quantity as bigint) as antal,
    nullif(cast(round(l_discount * 100) as bigint), 0) as discount,
    nullif(cast(round(l_tax * 100) as bigint), 0) as tax
  from lineitem)"""


def _wavg(c: str) -> str:
    return (
        f"round(cast(sum({c} * antal) as double) / "
        f"nullif(cast(sum(case when {c} is not null then antal end) as double), 0), 10)"
    )


YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
WIDE = RESULTS + """,
cells as (
  select kommun, huvudman_typ, subject, year,
    case when sum(n) % 7 = 0 then '..'
      else cast(cast(sum(n) as bigint) % 100 as varchar) || ',' || cast(cast(sum(cents) as bigint) % 10 as varchar) end as v
  from results group by 1, 2, 3, 4),
long as (
  select kommun, huvudman_typ, subject,
    cast(year as varchar) || '/' || lpad(cast((year + 1) % 100 as varchar), 2, '0') as year,
    try_cast(replace(v, ',', '.') as double) as value
  from cells where try_cast(replace(v, ',', '.') as double) is not null)"""

LINES = """
lines as (select unnest(str_split(text, chr(10))) as raw_line, source as source_file from documents)"""

SEPARATORS = [";", ",", "\t", "|"]


def _sniffed(table: str, key: str, text: str) -> str:
    counts = ", ".join(
        f"list_transform(head, lambda l: length(l) - length(replace(l, '{s}', ''))) as c{i}" for i, s in enumerate(SEPARATORS)
    )
    most = ", ".join(f"list_max(c{i}) as m{i}" for i in range(4))
    best = "greatest(m0, m1, m2, m3)"
    sep = "case " + " ".join(f"when m{i} = {best} then '{s}'" for i, s in enumerate(SEPARATORS)) + " end"
    start = "case " + " ".join(f"when m{i} = {best} then list_position(c{i}, m{i}) - 1" for i in range(4)) + " end"
    return f"""
sniffed as (
  select {key}, all_lines, {_not_blank('whole')} as has_text, {sep} as sep, cast({start} as integer) as start, {best} as n_seps
  from (select *, {most} from (select *, {counts} from (
    select {key}, {text} as whole, str_split({text}, chr(10)) as all_lines, str_split({text}, chr(10))[1:60] as head from {table}) a) b) c),
body as (
  select * from (
    select {key}, all_lines[start + 1] as header, sep, start, n_seps,
      unnest(all_lines) as raw_line, unnest(range(0, len(all_lines))) as ln
    from sniffed) t
  where ln > start and {_not_blank('raw_line')}),
widths as (
  select *, length(bare) - length(replace(bare, sep, '')) + 1 as n_fields
  from (select *, regexp_replace(raw_line, '"[^"]*"', '', 'g') as bare from body) t)"""


def _not_blank(c: str) -> str:
    blanks = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return f"regexp_matches({c}, '[^{blanks}]')"


def _status(table: str, key: str, text: str) -> str:
    return _sniffed(table, key, text) + f""",
status as (
  select s.{key}, case when not s.has_text or w.widest > s.n_seps + 1 then 'failed' else 'ok' end as status,
    case when not s.has_text then 'empty' when w.widest > s.n_seps + 1 then 'too_many_fields' end as reason,
    coalesce(w.n_rows, 0) as n_rows
  from sniffed s left join (
    select {key}, max(n_fields) as widest, count(*) as n_rows from widths group by 1) w on s.{key} = w.{key})"""


def _reprojected() -> str:
    """Krueger's series with the numbers of the ellipsoid and of grid 3006 put in."""
    radius, plane, latitude = series()
    a = " - ".join(["xi", *(f"({d!r}) * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, d in enumerate(plane, 1))])
    b = " - ".join(["eta", *(f"({d!r}) * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, d in enumerate(plane, 1))])
    more = " + ".join(f"({d!r}) * pow(sin(f), {2 * i})" for i, d in enumerate(latitude))
    return f"""
corners as (
  select c_custkey, unnest([0, 1, 2, 3])::integer as corner, 300000.0e0 + (c_custkey % 97) * 5000 as x, 6100000.0e0 + (c_custkey % 301) * 5000 as y from customer),
points as (
  select c_custkey, corner, x + case when corner in (1, 2) then 5000 else 0 end as x, y + case when corner = 2 then 5000 else 0 end as y from corners),
scaled as (select *, y / (0.9996e0 * {radius!r}) as xi, (x - 500000) / (0.9996e0 * {radius!r}) as eta from points),
sphere as (select *, {a} as a, {b} as b from scaled),
conformal as (select *, asin(sin(a) / cosh(b)) as f from sphere),
last as (select *, {more} as more from conformal)"""


SQUARES = """
squares as (
  select c_custkey, 'SE' || cast(c_custkey as varchar) as id, trim(c_name) as kommun,
    case when length(cast(c_custkey as varchar)) < 4 then lpad(cast(c_custkey as varchar), 4, '0')
      else cast(c_custkey as varchar) end as kommun_kod,
    lpad(cast(c_nationkey as varchar), 2, '0') as lan_kod,
    9.0e0 + (c_custkey % 67) * 0.25e0 as x0, 54.0e0 + (c_custkey % 71) * 0.25e0 as y0,
    9.5e0 + (c_custkey % 67) * 0.25e0 as x1, 54.5e0 + (c_custkey % 71) * 0.25e0 as y1
  from customer)"""


BUDGET = """
budget as (
  select kommun_kod, kommun, lasar_start, totalt_per_elev from (
    select *, row_number() over (partition by kommun_kod, lasar_start order by totalt_per_elev desc, o_orderkey) as rn from (
      select o_orderkey, 'K' || cast(o_custkey as varchar) as kommun, cast(extract(year from o_orderdate) as integer) as lasar_start,
        case when length(cast(o_custkey as varchar)) < 4 then lpad(cast(o_custkey as varchar), 4, '0')
          else cast(o_custkey as varchar) end as kommun_kod,
        cast(round(o_totalprice * 100) as bigint) as totalt_per_elev from orders) a) b
  where rn = 1)"""


def _keys(*columns: str) -> str:
    return ", ".join(["lasar_start", "kommun_kod", "huvudman_typ", "amne", *columns])


DOUBLE_ANDEL = "try_cast(nullif(replace(replace(andel, '~', ''), ',', '.'), '..') as double) as andel"
INT_ANTAL = "try_cast(nullif(replace(antal, ' ', ''), '..') as integer) as antal"

_BODIES: dict[str, tuple[str, str]] = {
    "lines_count_by_source": (LINES, "select source_file, count(*) as n_lines from lines group by 1"),
    "lines_count_matching": (
        LINES,
        "select source_file, count(*) as n_lines from lines "
        "where lower(source_file) like '%src1%' or lower(source_file) like '%c7' group by 1",
    ),
    "lines_nonblank": (LINES, f"select raw_line, source_file from lines where {_not_blank('raw_line')}"),
    "distinct_lines": (LINES, "select distinct raw_line, source_file from lines"),
    "drop_boilerplate": (RAW, "select raw_line, source_file from data"),
    "extract_url": (
        "",
        """select html || ' (' || url || ');' as statistik_text,
  nullif(regexp_extract(html || ' (' || url || ');', '(https?://[^\\s;,")]+)', 1), '') as url_value,
  cast(page_id as varchar) as source_file from pages""",
    ),
    "latest_load_only": (
        "loads as (select o_orderkey, o_custkey, cast(extract(year from o_orderdate) as varchar) as load_id from orders)",
        "select * from loads where load_id = (select max(load_id) from loads)",
    ),
    "sniff_delimiter": (_sniffed("documents", "doc_id", "text"), "select doc_id, sep, start, cast(n_seps as integer) as n_seps from sniffed"),
    "read_sniffed": (
        _sniffed("documents", "doc_id", "text"),
        """select doc_id, cast(ln as integer) as ln, header, raw_line, cast(n_fields as integer) as n_fields,
  cast(length(bare_header) - length(replace(bare_header, sep, '')) + 1 as integer) as n_names
from (select *, regexp_replace(header, '"[^"]*"', '', 'g') as bare_header from widths) t""",
    ),
    "quoted_records": (
        "",
        """select doc_id, cast(2 as integer) as n_fields, i as record, array_to_string(all_lines[3 * i + 1:3 * i + 3], chr(10)) as body
from (select doc_id, str_split(text, chr(10)) as all_lines from documents) t, unnest(range(0, (len(all_lines) + 2) // 3)) as u(i)""",
    ),
    "file_load_status": (_status("pages", "page_id", "html"), "select page_id, status, reason, n_rows from status"),
    "file_status_counts": (_status("documents", "doc_id", "text"), "select status, count(*) as n_files from status group by 1"),
    "parse_results_lines": (
        PARSED,
        f"select lasar_start, kommun, kommun_kod, lan, lan_kod, huvudman_typ, amne, {DOUBLE_ANDEL}, {INT_ANTAL}, source_file from parsed",
    ),
    "parse_split_part": (
        RAW,
        "select "
        + ", ".join(
            f"trim(split_part(raw_line, ';', {i + 1})) as {c}"
            for i, c in enumerate(
                ["kommun", "kommun_kod", "lan", "lan_kod", "huvudman_typ", "amne", "andel", "antal", "saknas"]
            )
        )
        + ", source_file from data",
    ),
    "clean_decimal_comma": (PARSED, f"select {_keys('try_cast(replace(andel, chr(44), chr(46)) as double) as andel')} from parsed"),
    "clean_thousands": (
        PARSED,
        "select "
        + _keys(
            "try_cast(replace(antal, ' ', '') as integer) as antal",
            "try_cast(replace(andel, ',', '.') as integer) as andel_heltal",
        )
        + " from parsed",
    ),
    "clean_sentinels": (PARSED, f"select {_keys(DOUBLE_ANDEL, INT_ANTAL)} from parsed"),
    "clean_sentinels_strict": (
        PARSED,
        "select "
        + _keys(
            "case when andel = '~100' then 100.0e0 when andel in ('..', '.', '') then null "
            "else cast(replace(andel, ',', '.') as double) end as andel"
        )
        + " from parsed",
    ),
    "clean_count_nbsp": (
        PARSED,
        "select "
        + _keys(
            "cast(replace(replace(replace(antal, ' ', chr(160)), ' ', ''), chr(160), '') as integer) as antal"
        )
        + " from parsed",
    ),
    "normalize_year": (
        "",
        """select o_orderkey, case when y between 1900 and 2100 then y
  else cast(substr(cast(y as varchar), 1, 4) as integer) end as year
from (select o_orderkey, case when o_orderkey % 3 = 0 then yy * 10000 + yy + 1 else yy end as y
  from (select o_orderkey, cast(extract(year from o_orderdate) as integer) as yy from orders) a) b""",
    ),
    "normalize_category": (
        "",
        """select c_custkey, case when lower(c_mktsegment) like '%auto%' then 'Car'
  when lower(c_mktsegment) like '%build%' then 'House' when lower(c_mktsegment) like '%mach%' then 'Works'
  else c_mktsegment end as category from customer""",
    ),
    "pad_code": (
        "",
        """select c_custkey, lpad(cast(c_custkey as varchar), 3, '0') as padded,
  case when length(cast(c_custkey as varchar)) < 3 then lpad(cast(c_custkey as varchar), 3, '0')
    else cast(c_custkey as varchar) end as filled from customer""",
    ),
    "gender_gap": (RESULTS, "select year, kommun, huvudman_typ, subject, f, m, f - m as gap_f_minus_m from results"),
    "percentile_score": (CHOICE, "select * from choice"),
    "rank_marts": (RANKED, "select * from ranked"),
    "rollup_all": (
        CHOICE,
        "select year, kommun, lan, huvudman_typ, subject, total, f, m, gap from grain",
    ),
    "fairness": (
        CHOICE,
        """select * exclude (performance_bucket, widest),
  round(100.0 * (1.0 - gap_abs / nullif(widest, 0.0)), 1) as fairness_score,
  dense_rank() over (partition by year, subject, huvudman_typ order by gap_abs asc nulls last) as fairness_rank_sweden,
  dense_rank() over (partition by year, subject, huvudman_typ, lan order by gap_abs asc nulls last) as fairness_rank_lan,
  case when gap_abs <= 1 then 'Balanced' when gap_abs <= 3 then 'Moderate gap' else 'High gap' end as fairness_label
from (select *, abs(betygpoang_gap_f_minus_m) as gap_abs,
    max(abs(betygpoang_gap_f_minus_m)) over (partition by year, subject, huvudman_typ) as widest
  from choice) t""",
    ),
    "yoy_trend": (TREND, "select * from trend"),
    "previous_year_any_rows": (
        """
o as (
  select o_orderkey, o_custkey, cast(extract(year from o_orderdate) as integer) as year,
    cast(round(o_totalprice * 100) as bigint) as cents from orders),
yearly as (
  select o_custkey, year, lag(top) over (partition by o_custkey order by year) as cents_prev_year
  from (select o_custkey, year, max(cents) as top from o group by 1, 2) t)""",
        "select o.*, cents_prev_year from o join yearly on o.o_custkey = yearly.o_custkey and o.year = yearly.year",
    ),
    "share_of_total": (SHARES, "select * from shares"),
    "share_recomputed": (
        SHARE,
        """select p.*, t.total_students, cast(p.n_students as double) / nullif(t.total_students, 0) as share
from pupils p left join (
  select kommun, cast(sum(n_students) as bigint) as total_students from pupils group by 1) t on p.kommun = t.kommun""",
    ),
    "weighted_mean_by_group": (
        WEIGHED,
        f"select kon, {_wavg('discount')} as discount, {_wavg('tax')} as tax from weighed "
        "where l_returnflag in ('A', 'R') group by 1",
    ),
    "weighted_mean_long": (
        WEIGHED,
        f"""select kon, 'Rabatt' as program, {_wavg('discount')} as behorighet_pct from weighed group by 1
union all select kon, 'Moms/Skatt', {_wavg('tax')} from weighed group by 1""",
    ),
    "dedup_latest_source": (
        "",
        """select o_custkey, year, o_orderpriority, o_orderdate, o_orderkey from (
  select *, row_number() over (partition by o_custkey, year order by o_orderdate desc, o_orderkey) as rn
  from (select *, cast(extract(year from o_orderdate) as integer) as year from orders) a) b where rn = 1""",
    ),
    "latest_per_key": (
        "",
        """select * from (
  select o_custkey, o_orderdate, o_orderkey, o_orderstatus,
    row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey) as rn
  from orders) t where rn = 1""",
    ),
    "table_head": ("", "select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 25"),
    "optional_filters": (
        RESULTS,
        "select year, kommun, lan, huvudman_typ, subject, n, cents from results where year = 1997 and huvudman_typ = 'N'",
    ),
    "option_list": (
        RESULTS,
        "select 0 as position, 'All' as option union all "
        "select distinct 1, subject from results where subject <> 'S7'",
    ),
    "option_list_dependent": (
        RESULTS,
        "select 0 as position, 'All' as option union all select distinct 1, kommun from results where lan = 'NATION_7'",
    ),
    "distinct_values": (RESULTS, "select distinct kommun as v from results"),
    "latest_year_rows": (SHARE, "select * from pupils where year = (select max(year) from pupils)"),
    "top_bottom_n": (
        SHARE + ",\nlatest as (select * from pupils where year = (select max(year) from pupils))",
        """select *, 'top' as side from (select * from latest order by n_students desc, kommun, huvudman_typ limit 10) t
union all select *, 'bottom' from (select * from latest order by n_students, kommun, huvudman_typ limit 10) b""",
    ),
    "metric_by_year": (RANKED, "select kommun_kod, kommun, avg_total from ranked where lasar_start = 1998"),
    "point_lookup": (RESULTS, "select kommun_kod, kommun, year, huvudman_typ, subject, n from results where kommun_kod = '000007'"),
    "trend_series": (SERIES, "select * from series"),
    "trend_series_lattice": (
        TREND + ",\nchosen as (select * from trend where subject = 'S2')",
        "select year, huvudman_typ as series, round(avg(score), 4) as score from chosen "
        "where year < (select max(year) from chosen) group by 1, 2",
    ),
    "trend_series_by_provider": (
        TREND + ",\nchosen as (select * from trend where subject = 'S2')",
        "select year, huvudman_typ as series, round(avg(score), 4) as score from chosen "
        "where year < (select max(year) from chosen) group by 1, 2",
    ),
    "series_last_point": (SERIES, "select * from series where year = (select max(year) from series)"),
    "series_own_last_point": (
        SHARE,
        """select kommun, year, n_students from (
  select kommun, year, cast(sum(n_students) as bigint) as n_students,
    row_number() over (partition by kommun order by year desc) as rn from pupils group by 1, 2) t where rn = 1""",
    ),
    "gap_topn": (
        RESULTS,
        """select kommun, betygpoang_flickor, betygpoang_pojkar, abs(betygpoang_flickor - betygpoang_pojkar) as gap_abs
from (select kommun, round(avg(f), 4) as betygpoang_flickor, round(avg(m), 4) as betygpoang_pojkar
  from results where year = 1997 group by 1) t order by gap_abs desc nulls last, kommun limit 10""",
    ),
    "gap_long": (
        RESULTS + """,
gaps as (
  select kommun, fm, mm, abs(fm - mm) as gap_abs
  from (select kommun, round(avg(f), 4) as fm, round(avg(m), 4) as mm from results group by 1) t
  order by gap_abs desc nulls last, kommun limit 10)""",
        """select *, row_number() over (order by gap_abs asc nulls first, kommun desc, "Group" desc) as position
from (select kommun, gap_abs, 'Girls' as "Group", fm as "Average grade points" from gaps
  union all select kommun, gap_abs, 'Boys', mm from gaps) t""",
    ),
    "topn_semijoin": (_top_shares(1997), "select * from top"),
    "order_by_pivot_share": (
        _top_shares(1998),
        """select *, row_number() over (order by "F" desc, kommun) as position from (
  select kommun, coalesce(round(avg(case when huvudman_typ = 'O' then share end), 10), 0) as "O",
    coalesce(round(avg(case when huvudman_typ = 'F' then share end), 10), 0) as "F" from top group by 1) t""",
    ),
    "axis_range": (_top_shares(1997), "select max(share) * 1.15e0 as axis_max from top"),
    "share_trend": (
        SHARE + """,
chosen as (select * from pupils where huvudman_typ in ('O', 'F')),
wide as (
  select year, kommun, cast(coalesce(sum(case when huvudman_typ = 'F' then n_students end), 0) as bigint) as "F",
    cast(coalesce(sum(case when huvudman_typ = 'O' then n_students end), 0) as bigint) as "O"
  from chosen where kommun in (
    select kommun from chosen group by 1 order by sum(n_students) desc, kommun limit 10) group by 1, 2)""",
        """select year, kommun, "F", "O", "F" + "O" as total,
  case when "F" + "O" > 0 then cast("F" as double) / ("F" + "O") else 0.0e0 end as share from wide""",
    ),
    "melt_years": (WIDE, "select * from long"),
    "passrate_trend": (
        WIDE,
        """select year, round(avg(case when huvudman_typ = 'A' then value end), 10) as "A",
  round(avg(case when huvudman_typ = 'N' then value end), 10) as "N"
from long where huvudman_typ in ('A', 'N') group by 1""",
    ),
    "passrate_by_subject": (
        WIDE + ",\nchosen as (select * from long where huvudman_typ in ('A', 'N'))",
        """select *, row_number() over (order by "A" desc nulls last, subject) as position from (
  select subject, round(avg(case when huvudman_typ = 'A' then value end), 10) as "A",
    round(avg(case when huvudman_typ = 'N' then value end), 10) as "N"
  from chosen where year = '2001/02' group by 1) t""",
    ),
    "delta_last_two_years": (
        WIDE + """,
yearly as (
  select cast(substr(year, 1, 4) as integer) as year, round(avg(value), 10) as v
  from long where huvudman_typ = 'N' and subject = 'S2' group by 1),
lagged as (
  select year, v, lag(year) over (order by year) as year_prev, lag(v) over (order by year) as v_prev from yearly)""",
        """select year_prev, year as year_last, round(v - v_prev, 10) as delta,
  case when v - v_prev < 0 then 'decreased' else 'increased' end as direction
from lagged where year = (select max(year) from yearly) and year_prev is not null""",
    ),
    "mean_over_time": (
        "",
        "select cast(extract(year from l_shipdate) as integer) as year, "
        + ", ".join(f"round(avg(case when l_returnflag = '{f}' then l_quantity end), 10) as \"{f}\"" for f in "ANR")
        + " from lineitem group by 1",
    ),
    "geo_codes": (SQUARES, "select kommun, kommun_kod, lan_kod from squares"),
    "geo_bbox_filter": (
        SQUARES,
        "select kommun_kod from squares where x0 <= 24.5 and x1 >= 10.5 and y0 <= 69.5 and y1 >= 55.0",
    ),
    "geo_join_values": (
        SQUARES,
        """select s.kommun, s.kommun_kod, v.cents from squares s left join (
  select o_custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents
  from orders group by 1) v on s.c_custkey = v.o_custkey""",
    ),
    "geo_feature_json": (
        SQUARES,
        """select '{"type":"Feature","properties":{"kommun":"' || kommun || '","kommun_kod":"' || kommun_kod
  || '","lan_kod":"' || lan_kod || '"},"geometry":{"type":"MultiPolygon","coordinates":[[[['
  || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],['
  || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]]}}' as feature from squares""",
    ),
    "geo_simplify": (
        SQUARES,
        """select '{"type":"Feature","properties":{"kommun_kod":"' || lpad(cast(c_custkey as varchar), 8, '0')
  || '"},"geometry":{"type":"MultiPolygon","coordinates":[[[['
  || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],['
  || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]]}}' as feature from squares""",
    ),
    "geo_simplify_borders": (
        """
cells as (select c_custkey, c_custkey % 30 as i, c_custkey // 30 as j from customer),
sides as (
  select c_custkey, i, j, 1 as across from cells union all select c_custkey, i, j + 1, 1 from cells
  union all select c_custkey, i, j, 0 from cells union all select c_custkey, i + 1, j, 0 from cells)""",
        """select c_custkey, 9.0e0 + 0.25e0 * (i + a) as x, 54.0e0 + 0.25e0 * (j + b) as y from cells, (values (0, 0), (1, 0), (0, 1), (1, 1)) as c(a, b)
union all select c_custkey, 9.0e0 + 0.25e0 * i + case when across = 1 then 0.125e0 else 0.0625e0 end,
  54.0e0 + 0.25e0 * j + case when across = 1 then 0.0625e0 else 0.125e0 end from sides where (i * 7 + j * 3 + across) % 5 = 0""",
    ),
    "geo_collection": (SQUARES, """select id, kommun || ' {"}[\\' as label, x0 as xmin, y0 as ymin, x1 as xmax, y1 as ymax from squares"""),
    "geo_reproject": (
        _reprojected(),
        "select c_custkey, 4326 as srid, corner, round(15 + degrees(atan(sinh(b) / cos(a))), 7) as lon, round(degrees(f + sin(f) * cos(f) * more), 7) as lat from last",
    ),
    "geo_srid": (SQUARES, "select id, 4326 as srid from squares"),
    "loaded_table": ("", "select s_suppkey, s_name from supplier"),
    "parameter_query": ("", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' and o_orderkey >= 100"),
    "shares_filled": (
        _top_shares(1997),
        """select * exclude (share, whole), case when n_students % 3 <> 0 then share
    else cast(n_students as double) / nullif(cast(whole as double), 0.0e0) end as share
from (select *, sum(n_students) over (partition by kommun) as whole from top) t""",
    ),
    "school_choice": (
        SHARE + """,
counted as (
  select year, kommun, lan, case when huvudman_typ = 'O' then 'Kommunal' else 'Enskild' end as huvudman_typ, n_students
  from pupils where n_students % 7 <> 0 and n_students % 11 <> 0 and n_students % 13 <> 0)""",
        """select c.*, n_total, case when n_total = 0 then 0.0e0 else cast(n_students as double) / n_total end as share
from counted c join (
  select year, kommun, lan, cast(sum(n_students) as bigint) as n_total from counted group by 1, 2, 3) t
  on c.year = t.year and c.kommun = t.kommun and c.lan = t.lan""",
    ),
    "gap_topn_fairness": (
        CHOICE,
        """select kommun, betygpoang_flickor, betygpoang_pojkar, abs(betygpoang_flickor - betygpoang_pojkar) as gap_abs
from (select kommun, round(avg(betygpoang_flickor), 4) as betygpoang_flickor, round(avg(betygpoang_pojkar), 4) as betygpoang_pojkar
  from choice where year = 1997 group by 1) t order by gap_abs desc nulls last, kommun limit 10""",
    ),
    "trend_any_rows": (TREND, "select * from trend"),
    "budget_rows": (
        BUDGET,
        "select kommun_kod, kommun, totalt_per_elev from budget where lasar_start = (select max(lasar_start) from budget)",
    ),
    "budget_map": (
        BUDGET + "," + SQUARES,
        """select s.kommun_kod, b.totalt_per_elev from squares s
left join (select * from budget where lasar_start = 1997) b on s.kommun_kod = b.kommun_kod
where x0 <= 24.5 and x1 >= 10.5 and y0 <= 69.5 and y1 >= 55.0""",
    ),
    "budget_extremes": (
        BUDGET + """,
one as (select kommun_kod, kommun, cast(totalt_per_elev as double) as totalt_per_elev from budget where lasar_start = 1996)""",
        """select *, 'top' as side from (select * from one order by totalt_per_elev desc, kommun limit 10) t
union all select *, 'bottom' from (select * from one order by totalt_per_elev, kommun limit 10) b""",
    ),
    "expect_not_null": (
        PARSED,
        "select 'results' as relation, 'kommun' as column, count(*) - count(kommun) as failures from parsed "
        "union all select 'results', 'andel', count(*) - count(try_cast(nullif(replace(replace(andel, '~', ''), ',', '.'), '..') as double)) from parsed "
        "union all select 'results', 'antal', count(*) - count(antal) from parsed "
        "union all select 'results', 'source_file', count(*) - count(source_file) from parsed",
    ),
}


def statements() -> dict[str, str]:
    return {name: (f"with {ctes.strip()}\n{body}" if ctes else body) for name, (ctes, body) in _BODIES.items()}
