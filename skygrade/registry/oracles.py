"""Independent SQL for every query whose result SQL can state.

The statements follow the definitions, not the library's plans: fills are joins,
classes are nearest centres, quantiles are the engine's own.
"""

from skygrade.functions.scalars import STAMP_SHAPES
from skygrade.plans.features import feature_set_adv, feature_set_base, lag_columns
from skygrade.registry.queries import GIVEN_WEIGHTS, LISTED_SITES, ONE_SITE
from skygrade.schema import BANDS, CLASS_COLUMNS, POLLUTANTS, TARGETS, WEATHER_VS_CLASS, WEATHER_VS_POLLUTANTS
from skygrade.sources.tables import CUSTOMERS_PER_SITE, LATER_YEAR, USERS_PER_SITE, WEATHER_PER_SITE

ADV = feature_set_adv()
CLASSIFIER_QUERIES = {
    "cls_random_forest": "RandomForest",
    "cls_logistic": "LogisticRegression",
    "cls_svm": "SVM",
    "cls_boosted": "GradientBoosting",
    "cls_tree": "DecisionTree",
    "cls_mlp": "MLP",
}


def each(template, names, sep=", "):
    return sep.join(template.format(c=n) for n in names)


def rnd(names):
    return each("round({c}, 6) as {c}", names)


def avg(names):
    return each("avg({c}) as {c}", names)


# Input tables

READINGS = f"""
select event_id, 'D' || (user_id // {USERS_PER_SITE}) as site, ts, cast(ts as date) as dt,
  cast(extract(year from ts) as int) as yr, cast(extract(week from ts) as int) as wk,
  case event_type when 'click' then value / 0.99991e0 end as no2,
  case event_type when 'view' then value / 0.76913e0 end as o3,
  case event_type when 'purchase' then value / 2.50007e0 end as pm25,
  case event_type when 'signup' then value / 1.11119e0 end as pm10,
  case event_type when 'error' then value / 0.50021e0 end as so2
from events"""

WEATHER = f"""
select o_orderkey as weather_id, 'D' || (o_custkey // {WEATHER_PER_SITE}) as site,
  cast(date '2024-01-01' + cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 30 as int) as date) as dt,
  o_totalprice / 9973e0 as temperature_2m, cast(o_custkey % 100 as double) as relative_humidity_2m,
  case when o_orderkey % 11 <> 0 then cast(o_orderkey % 10 as double) end as rain,
  cast(o_custkey % 30 as double) as wind_speed_80m, cast(o_orderkey % 12 as double) as uv_index_max,
  o_totalprice / 12007e0 as temperature_80m, cast(o_orderkey % 360 as double) as wind_direction_80m,
  o_totalprice / 9973e0 + o_custkey % 5 as temperature_2m_max,
  o_totalprice / 9973e0 - o_orderkey % 5 as temperature_2m_min
from orders"""

WEATHER_COLUMNS = (
    "temperature_2m",
    "relative_humidity_2m",
    "rain",
    "wind_speed_80m",
    "uv_index_max",
    "temperature_80m",
    "wind_direction_80m",
    "temperature_2m_max",
    "temperature_2m_min",
)

COHORT_ROWS = f"""
select o_orderkey as reading_id, 'D' || (o_custkey // {CUSTOMERS_PER_SITE}) as site,
  o_orderdate + to_hours(cast(o_orderkey % 24 as int)) as ts, cast(o_orderdate as date) as dt,
  cast(extract(year from o_orderdate) as int) as yr, cast(extract(week from o_orderdate) as int) as wk,
  case when o_orderkey % 13 <> 0 then o_totalprice / 499.979e0 end as no2,
  case when o_orderkey % 7 <> 3 then cast(o_orderkey % 250 as double) / 0.99991e0 end as o3,
  cast(o_custkey % 60 as double) / 0.99991e0 as pm25,
  cast(o_custkey % 120 as double) / 0.99991e0 as pm10,
  cast(o_orderkey % 400 + case when o_orderkey % 97 = 5 then 9000 else 0 end as double) / 0.99991e0 as so2
from orders"""


# Clean tables


def nearest_class(p):
    gaps = ", ".join(f"abs({p} - {(low + high) / 2}e0)" for low, high in BANDS[p])
    return f"case when {p} is not null then cast(list_position([{gaps}], list_min([{gaps}])) as int) end"


GRADES = ", ".join(f"{nearest_class(p)} as {p}_cls" for p in POLLUTANTS)
CLASS_MEAN = f"list_avg([{', '.join(CLASS_COLUMNS)}]) as class_mean"


def clean(source, grain):
    """CTE bodies that fill by week, average by grain and grade."""
    return f"""
select *, {CLASS_MEAN} from (select *, {GRADES} from (
  select r.site, r.{grain}, r.yr, r.wk, {each("avg(coalesce(r.{c}, w.{c})) as {c}", POLLUTANTS)}
  from {source} r left join (select site, yr, wk, {avg(POLLUTANTS)} from {source} group by site, yr, wk) w
    on r.site = w.site and r.yr = w.yr and r.wk = w.wk
  where r.site is not null and r.{grain} is not null
  group by r.site, r.{grain}, r.yr, r.wk))"""


ROLLED = ", ".join(
    f"case when count({c}) over w3 = 3 then avg({c}) over w3 end as {c}_roll3" for c in TARGETS
)
LAGGED = ", ".join(f"lag({c}, {i}) over w as {c}_lag{i}" for i in (1, 2) for c in TARGETS)


def expanding(source, n, k="site"):
    start = f"_n - ({n} - fold) * (_n // {n + 1})"
    return f"""
select * from (select t.* exclude (_rn, _n), fold,
    case when _rn < {start} then 'train' when _rn < {start} + _n // {n + 1} then 'test' end as role
  from (select *, row_number() over (partition by {k} order by dt) - 1 as _rn,
      count(*) over (partition by {k}) as _n from {source}) t,
    (select unnest(range({n}))::int as fold))
where role is not null"""


TABLES = {
    "readings": READINGS,
    "weather": WEATHER,
    "cohort_rows": COHORT_ROWS,
    "earlier_rows": f"select * from cohort_rows where yr < {LATER_YEAR}",
    "later_rows": f"select * from cohort_rows where yr = {LATER_YEAR}",
    "weeks": f"select site, yr, wk, {avg(POLLUTANTS)} from readings group by site, yr, wk",
    "daily": clean("readings", "dt"),
    "earlier_clean": f"select *, cast(ts as date) as dt from ({clean('earlier_rows', 'ts')})",
    "later_clean": clean("later_rows", "dt"),
    "earlier": """select *, 'earlier' as cohort from earlier_clean
where strftime(dt, '%m-%d') in (select strftime(dt, '%m-%d') from later_clean)""",
    "later": "select *, 'later' as cohort from later_clean",
    "stacked": "select * from earlier union all by name select * from later",
    "variation": f"""select a.site, {each("(b.{c} - a.{c}) / nullif(a.{c}, 0) * 100 as {c}", POLLUTANTS)}
from (select site, {avg(POLLUTANTS)} from earlier group by site) a
join (select site, {avg(POLLUTANTS)} from later group by site) b on a.site = b.site""",
    "eda": "select d.*, w.* exclude (site, dt) from daily d left join weather w on d.site = w.site and d.dt = w.dt",
    "weather_daily": f"select site, dt, {avg(WEATHER_COLUMNS)} from weather group by site, dt",
    "model": f"""select d.*, w.* exclude (site, dt) from daily d join weather_daily w on d.site = w.site and d.dt = w.dt
where {each("{c} is not null", (*POLLUTANTS, *CLASS_COLUMNS, "class_mean", *WEATHER_COLUMNS), " and ")}""",
    "adv": f"""select *, {LAGGED}, {ROLLED}, cast(month(dt) as int) as month, cast(isodow(dt) - 1 as int) as weekday
from model window w as (partition by site order by dt), w3 as (partition by site order by dt rows 2 preceding)""",
    "filled": f"""select * replace ({each("coalesce(last_value({c} ignore nulls) over wb, first_value({c} ignore nulls) over wa) as {c}", lag_columns())})
from adv window wb as (partition by site order by dt rows between unbounded preceding and current row),
  wa as (partition by site order by dt rows between current row and unbounded following)""",
    "class_folds": expanding("filled", 5),
    "long_rows": " union all ".join(
        f"select site, dt, '{t}' as target, {t} as y, {t}_lag1 as lag1, {t}_lag2 as lag2, {t}_roll3 as roll3 from adv"
        for t in TARGETS
    ),
    "persistence": "select site, dt, target, y, lag1 as p from long_rows where lag1 is not null",
    "class_rows": f"""select site, dt, {each("{c}", CLASS_COLUMNS)}, {each("lag({c}) over w as {c}_lag1", CLASS_COLUMNS)}
from model window w as (partition by site order by dt)""",
    "class_lag_folds": expanding("class_rows", 5),
    "class_persistence": " union all ".join(
        f"select site, dt, fold, '{c}' as target, {c} as y, {c}_lag1 as p from class_lag_folds where role = 'test' and {c}_lag1 is not null"
        for c in CLASS_COLUMNS
    ),
    "class_long": " union all ".join(
        f"select site, dt, fold, role, '{c}' as target, {c} as label from class_folds" for c in CLASS_COLUMNS
    ),
    "kept_folds": """select site, fold, target from class_long where role = 'train'
group by site, fold, target having count(distinct label) >= 2""",
}


def needs(text, names):
    """Tables a statement reads, directly or not, in order of definition."""
    import re

    found, queue = set(), [text]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        fresh = [n for n in names if n in words and n not in found]
        found.update(fresh)
        queue += [TABLES[n] for n in fresh]
    return [n for n in names if n in found]


def statement(body):
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in needs(body, list(TABLES)))
    return f"with {ctes}\n{body}" if ctes else body


def corr(a, b):
    both = f"{a} is not null and {b} is not null"
    r = f"corr({a}, {b}) filter ({both})"
    return f"select '{a}' as a, '{b}' as b, round(case when not isnan({r}) then {r} end, 6) as r, count(*) filter ({both}) as n"


def corr_block(left, right, source):
    return " union all ".join(f"{corr(a, b)} from {source}" for a in left for b in right)


def boxes(source, by=()):
    """Five numbers and outlier counts of every pollutant."""
    lead = "".join(f"{c}, " for c in by)
    long = " union all ".join(
        f"select {lead}'{p}' as col, {p} as value from {source} where {p} is not null" for p in POLLUTANTS
    )
    return f"""
long as ({long}),
quartiles as (select {lead}col, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
  quantile_cont(value, 0.75) as q3 from long group by {lead}col),
fences as (select *, q1 - 1.5e0 * (q3 - q1) as lo, q3 + 1.5e0 * (q3 - q1) as hi from quartiles)"""


def box_sql(source, by=()):
    lead = "".join(f"f.{c}, " for c in by)
    match = " and ".join(f"l.{c} = f.{c}" for c in (*by, "col"))
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in needs(source, list(TABLES)))
    return f"""with {ctes},{boxes(source, by)}
select {lead}f.col, {each("round(f.{c}, 6) as {c}", ("q1", "median", "q3"))},
  round(least(min(value) filter (value >= lo), q1), 6) as lo_whisker,
  round(greatest(max(value) filter (value <= hi), q3), 6) as hi_whisker,
  count(*) filter (value < lo or value > hi) as n_out
from long l join fences f on {match} group by {lead}f.col, q1, median, q3"""


def outlier_sql():
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in needs("stacked", list(TABLES)))
    return f"""with {ctes},{boxes("stacked", ("cohort",))},
rows_long as ({" union all ".join(f"select site, dt, ts, cohort, '{p}' as col, {p} as value from stacked" for p in POLLUTANTS)})
select site, dt, ts, l.cohort, l.col, round(value, 6) as value
from rows_long l join fences f on l.cohort = f.cohort and l.col = f.col where value < lo or value > hi"""


def f1_sql():
    return statement(
        """select site, target, round(sum(f1 * pos) / sum(pos), 6) as value from (
  select site, target, cls, sum(pos) as pos, 2e0 * sum(tp) / (sum(pos) + sum(named)) as f1 from (
    select site, target, y as cls, 1 as pos, 0 as named, cast(y = p as int) as tp from class_persistence
    union all select site, target, p, 0, 1, 0 from class_persistence)
  group by site, target, cls)
group by site, target"""
    )


def bayes_sql():
    """Log prior plus log likelihood of every class seen in training, highest wins."""
    feature_rows = " union all ".join(
        f"select site, dt, fold, role, '{f}' as feature, cast({f} as double) as x from class_folds" for f in ADV
    )
    body = f"""
features as ({feature_rows}),
widest as (select site, fold, max(v) as widest from (
  select site, fold, feature, var_pop(x) as v from features where role = 'train' group by site, fold, feature)
  group by site, fold),
moments as (select l.site, l.fold, l.target, l.label, f.feature, count(*) as n, avg(x) as mean, var_pop(x) as var
  from class_long l join features f on l.site = f.site and l.dt = f.dt and l.fold = f.fold
  join kept_folds k on k.site = l.site and k.fold = l.fold and k.target = l.target
  where l.role = 'train' and f.role = 'train' group by l.site, l.fold, l.target, l.label, f.feature),
totals as (select site, fold, target, count(*) as total from class_long where role = 'train' group by site, fold, target),
scores as (select f.site, f.dt, f.fold, m.target, m.label,
    any_value(ln(m.n / t.total)) - 0.5e0 * sum(ln(2 * pi() * (var + 1e-9 * widest)) + (x - mean) ** 2 / (var + 1e-9 * widest)) as score
  from features f join moments m on m.site = f.site and m.fold = f.fold and m.feature = f.feature
  join totals t on t.site = m.site and t.fold = m.fold and t.target = m.target
  join widest s on s.site = f.site and s.fold = f.fold
  where f.role = 'test' group by f.site, f.dt, f.fold, m.target, m.label),
best as (select *, row_number() over (partition by site, dt, fold, target order by score desc, label) as place from scores)
select b.site, b.dt, b.target, b.fold, l.label as y, b.label as p
from best b join class_long l on l.site = b.site and l.dt = b.dt and l.fold = b.fold and l.target = b.target
where place = 1"""
    return with_more(body)


def with_more(body, recursive=False):
    """A statement whose body starts with further tables of its own."""
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in needs(body, list(TABLES)))
    return f"with {'recursive ' if recursive else ''}{ctes},{body}"


def knn_sql():
    vector = f"[{each('cast({c} as double)', ADV)}]"
    body = f"""
points as (select site, dt, fold, role, {vector} as x from class_folds),
pairs as (select q.site, q.dt, q.fold, t.dt as near,
    row_number() over (partition by q.site, q.dt, q.fold order by list_distance(q.x, t.x), t.dt) as place
  from points q join points t on q.site = t.site and q.fold = t.fold and q.role = 'test' and t.role = 'train'),
votes as (select p.site, p.dt, p.fold, l.target, l.label, count(*) as n
  from pairs p join class_long l on l.site = p.site and l.dt = p.near and l.fold = p.fold
  join kept_folds k on k.site = l.site and k.fold = l.fold and k.target = l.target
  where place <= 5 group by p.site, p.dt, p.fold, l.target, l.label),
best as (select *, row_number() over (partition by site, dt, fold, target order by n desc, label) as place from votes)
select b.site, b.dt, b.target, b.fold, l.label as y, b.label as p
from best b join class_long l on l.site = b.site and l.dt = b.dt and l.fold = b.fold and l.target = b.target
where b.place = 1"""
    return with_more(body)


def gram_sql():
    x = ["1e0", *[f"lag{i}" for i in range(1, 8)]]
    cells = [f"round(sum({a} * {b}), 6)" for a in x for b in x] + [f"round(sum({a} * class_mean), 6)" for a in x]
    return f"""select site, n_rows, unnest(range({len(cells)}))::int as cell, unnest(cells) as value
from (select site, count(*) as n_rows, [{", ".join(cells)}] as cells from ar group by site)"""


AR = """ar as (select * from (select site, dt, class_mean, {lags} from model window w as (partition by site order by dt))
where {full})""".format(
    lags=each("lag(class_mean, {c}) over w as lag{c}", range(1, 8)),
    full=each("lag{c} is not null", range(1, 8), " and "),
)


NEWEST = """newest as (select site, max(dt) as dt, list(class_mean order by dt desc)[1:7] as h
  from model group by site having count(*) >= 7)"""


def forecast_sql():
    step = " + ".join(f"{w}e0 * h[{i}]" for i, w in enumerate(GIVEN_WEIGHTS) if i)
    return with_more(
        f"""
{NEWEST},
ahead as (select site, dt, 0 as step, h from newest
  union all select site, dt, step + 1, list_prepend({GIVEN_WEIGHTS[0]}e0 + {step}, h) from ahead where step < 7)
select site, cast(dt + step as date) as dt, step, round(h[1], 6) as p from ahead where step > 0""",
        recursive=True,
    )


def solved():
    """Normal equations of every site, solved by elimination; SPD, so pivots need no search."""
    x = ["1e0", *[f"lag{i}" for i in range(1, 8)]]
    rows = [
        "[" + ", ".join([f"sum({a} * {b}){' + 1e-3' if i and i == j else ''}" for j, b in enumerate(x)] + [f"sum({a} * class_mean)"]) + "]"
        for i, a in enumerate(x)
    ]
    return f"""
{AR},
steps as (select site, n_rows, 0 as j, m from (select site, count(*) as n_rows, [{", ".join(rows)}] as m from ar group by site)
  union all select site, n_rows, j + 1, list_transform(m, lambda r, i: case when i = j + 1
    then list_transform(r, lambda v: v / r[j + 1])
    else list_transform(r, lambda v, c: v - r[j + 1] / m[j + 1][j + 1] * m[j + 1][c]) end) from steps where j < 8),
weights as (select site, n_rows, list_transform(m, lambda r: r[9]) as w from steps where j = 8),
{NEWEST}"""


FITTED = "w[1] + list_dot_product(w[2:8], {values})"


def fit_sql():
    return with_more(
        f"{solved()}\nselect site, n_rows, unnest(range(8))::int as lag, round(unnest(w), 6) as weight from weights", recursive=True
    )


def forecast_fitted_sql():
    return with_more(
        f"""{solved()},
ahead as (select n.site, dt, 0 as step, h, w from newest n join weights using (site)
  union all select site, dt, step + 1, list_prepend({FITTED.format(values="h[1:7]")}, h), w from ahead where step < 7)
select site, cast(dt + step as date) as dt, step, round(h[1], 6) as p from ahead where step > 0""",
        recursive=True,
    )


def fit_scores_sql():
    lags = ", ".join(f"lag{i}" for i in range(1, 8))
    return with_more(
        f"""{solved()},
pred as (select site, class_mean as y, {FITTED.format(values=f"[{lags}]")} as p, avg(class_mean) over (partition by site) as mean
  from ar join weights using (site)),
scores as (select site, avg(abs(y - p)) as mae, sqrt(avg((y - p) ** 2)) as rmse,
  case when sum((y - mean) ** 2) = 0 then case when sum((y - p) ** 2) = 0 then 1 else 0 end
    else 1 - sum((y - p) ** 2) / sum((y - mean) ** 2) end as r2 from pred group by site)
select site, 'mae' as metric, round(mae, 6) as value from scores union all
select site, 'rmse', round(rmse, 6) from scores union all select site, 'r2', round(r2, 6) from scores""",
        recursive=True,
    )


def raw(p):
    return f"case when event_id % 17 <> 0 then {p} end"


def impute_sql(over, extra=""):
    return f"select site, dt, {extra}{each('round(coalesce({c}, ' + over + '), 6) as {c}', lag_columns())} from "


def number_text():
    price = "cast(o_totalprice as varchar)"
    return f"""case o_orderkey % 8 when 0 then ' ' || {price} || ' ' when 1 then {price} || 'd' when 2 then 'nan'
when 3 then '12,5' when 4 then '-' when 5 then '' else {price} end"""


SPLIT = """split as (select *, case when _rn >= _n - ceil(_n * 0.2e0) then 'test' else 'train' end as role from (
  select *, row_number() over (partition by site order by dt) - 1 as _rn, count(*) over (partition by site) as _n from {source}))"""


SITE_DAY_MEAN = "select site, dt, round(class_mean, 6) as class_mean from daily"

PLAIN = {
    "src_readings": f"select site, dt, yr, wk, {', '.join(f'round({raw(p)}, 6) as {p}' for p in POLLUTANTS)} from readings",
    "src_readings_mixed": f"select site, dt, yr, wk, {', '.join(f'round({raw(p)}, 6) as {p}' for p in POLLUTANTS)} from readings",
    "src_lost_dates": """select case event_id % 2 when 0 then 'slash' else 'iso' end as shape, count(*) as n_texts, 0::bigint as n_lost
from readings group by shape""",
    "src_readings_hourly": f"select site, ts, cast(ts as date) as dt, yr, wk, {rnd(POLLUTANTS)} from cohort_rows",
    "src_weather": f"""select site, cast(case when weather_id % 2 = 0 then dt else dt - 1 end as date) as dt, {rnd(WEATHER_COLUMNS)}
from weather""",
    "src_optional": """select 'readings' as source, 'loaded' as status, cast(null as varchar) as reason, count(*) as n_rows from readings
union all select 'hourly', 'loaded', null, count(*) from cohort_rows
union all select 'weather', 'loaded', null, count(*) from weather
union all select 'undated weather', 'skipped', 'weather: no column dt', 0""",
    "schema_repair": f"select site, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {rnd(POLLUTANTS)} from cohort_rows",
    "sink_table": f"""select yr, count(*) as n_rows, round(avg(class_mean), 6) as class_mean
from ({clean("cohort_rows", "ts")}) group by yr""",
    "project_rename": "select dt as date, site as distrito, round(class_mean, 6) as media from daily",
    "project_dynamic": f"select site, dt, {each('{c}', CLASS_COLUMNS)} from daily",
    "add_literal": "select site, dt, round(class_mean, 6) as class_mean, '2025' as cohort from daily",
    "filter_in_list": f"{SITE_DAY_MEAN} where site in ({', '.join(repr(s) for s in LISTED_SITES)})",
    "filter_eq": f"{SITE_DAY_MEAN} where site = '{ONE_SITE}'",
    "drop_null_any": f"select weather_id, site, dt, {rnd(WEATHER_COLUMNS)} from weather where rain is not null",
    "drop_null_subset": f"select reading_id, {rnd(POLLUTANTS)} from cohort_rows where no2 is not null and o3 is not null",
    "null_check": " union all ".join(
        f"select '{c}' as col, count(*) > count({c}) as has_null from weather"
        for c in ("weather_id", "site", "dt", *WEATHER_COLUMNS)
    ),
    "join_group_mean": f"""select event_id, {each("round(r.{c}, 6) as {c}", POLLUTANTS)}, {each("round(w.{c}, 6) as {c}_media", POLLUTANTS)}
from readings r left join weeks w on r.site = w.site and r.yr = w.yr and r.wk = w.wk""",
    "join_weather_left": f"select site, dt, {rnd(('class_mean',))}, weather_id, {rnd(('temperature_2m', 'rain'))} from eda",
    "join_weather_inner": f"""select d.site, d.dt, {rnd(("no2", "class_mean", *WEATHER_VS_POLLUTANTS))}
from daily d join weather_daily w on d.site = w.site and d.dt = w.dt""",
    "join_suffix": f"""select a.site, {each("round(a.{c}, 6) as {c}_earlier", POLLUTANTS)}, {each("round(b.{c}, 6) as {c}_later", POLLUTANTS)}
from (select site, {avg(POLLUTANTS)} from earlier group by site) a
join (select site, {avg(POLLUTANTS)} from later group by site) b on a.site = b.site""",
    "semi_month_day": """select reading_id, site, dt from earlier_rows
where strftime(dt, '%m-%d') in (select strftime(dt, '%m-%d') from later_rows)""",
    "semi_valid_site": "select weather_id, site from weather where site in (select site from readings)",
    "agg_week_mean": f"select site, yr, wk, {rnd(POLLUTANTS)} from weeks",
    "agg_day_mean": f"select site, dt, yr, wk, {rnd(POLLUTANTS)} from daily",
    "agg_hour_mean": f"select site, ts, yr, wk, {rnd(POLLUTANTS)} from ({clean('cohort_rows', 'ts')})",
    "agg_day_all_sites": f"select dt, {each('round(avg({c}), 6) as {c}', POLLUTANTS)} from daily group by dt",
    "agg_site_mean": f"select site, {each('round(avg({c}), 6) as {c}', POLLUTANTS)} from stacked group by site",
    "agg_numeric_all": f"select site, dt, {rnd(WEATHER_COLUMNS)} from weather_daily",
    "agg_cohort_mean": "select cohort, round(avg(class_mean), 6) as mean from stacked group by cohort",
    "freq_table": "select so2_cls as value, count(*) as count from daily where so2_cls is not null group by so2_cls",
    "corr_complete": corr_block(
        (*WEATHER_VS_CLASS, "class_mean"),
        (*WEATHER_VS_CLASS, "class_mean"),
        f"(select * from eda where {each('{c} is not null', (*WEATHER_VS_CLASS, 'class_mean'), ' and ')})",
    ),
    "corr_pairwise": corr_block(WEATHER_VS_POLLUTANTS, POLLUTANTS, "eda"),
    "agg_max_date": "select site, max(dt) as dt from readings group by site",
    "distinct_values": "select distinct site from weather",
    "distinct_classes": f"""select site, fold, count(distinct no2_cls) as n_classes from ({expanding("model", 5)})
where role = 'train' group by site, fold""",
    "lag_features": f"select site, dt, {rnd([c for c in lag_columns() if 'lag' in c])} from adv",
    "roll3_mean": f"select site, dt, {rnd([c for c in lag_columns() if 'roll' in c])} from adv",
    "roll3_mean_strict": f"""select site, dt, {", ".join(f"round(case when count({c}) over w = 3 then avg({c}) over w end, 6) as {c}_roll3" for c in TARGETS)}
from model window w as (partition by site order by dt rows between 3 preceding and 1 preceding)""",
    "fill_forward_back": f"select site, dt, {rnd(lag_columns())} from filled",
    "tail_n": f"{SITE_DAY_MEAN} qualify row_number() over (partition by site order by dt desc) <= 7",
    "sort_series": f"{SITE_DAY_MEAN} order by site, dt",
    "rank_variation": " union all ".join(
        f"""select '{p}' as pollutant, site, round({p}, 6) as change,
  row_number() over (order by {p} desc nulls last, site) as rank from variation"""
        for p in POLLUTANTS
    ),
    "head_n": f"{SITE_DAY_MEAN} order by dt, site limit 5",
    "union_by_name": f"select cohort, site, dt, ts, {rnd(POLLUTANTS)} from stacked",
    "to_number": f"""select o_orderkey, case when regexp_full_match(t, '\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?\\s*')
  then try_cast(trim(t) as double) end as number from (select o_orderkey, {number_text()} as t from orders)""",
    "parse_dayfirst": f"""select o_orderkey, {each("case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as {c}_day", ("slash", "dash", "iso"))}
from orders""",
    "parse_strict": "select event_id, ts as at from events",
    "parse_stamps": f"""select event_id, {each("date_trunc('second', ts) as {c}", STAMP_SHAPES)} from events""",
    "parse_utc": """select event_id, date_trunc('second', ts) - case when event_id % 3 = 0 then interval 2 hour else interval 0 hour end as at
from events""",
    "trunc_day": "select event_id, cast(ts as date) as day from events",
    "iso_week_year": """select o_orderkey, cast(extract(year from o_orderdate) as int) as yr,
  cast(extract(week from o_orderdate) as int) as wk from orders""",
    "iso_week_year_strict": """select o_orderkey, cast(extract(isoyear from o_orderdate) as int) as yr,
  cast(extract(week from o_orderdate) as int) as wk from orders""",
    "month_weekday": """select o_orderkey, cast(month(o_orderdate) as int) as month,
  cast(isodow(o_orderdate) - 1 as int) as weekday from orders""",
    "month_day_key": "select o_orderkey, strftime(o_orderdate, '%m-%d') as md from orders",
    "date_plus": "select o_orderkey, cast(cast(o_orderdate as date) + 7 as date) as later from orders",
    "norm_name": """select doc_id, md5(array_to_string(list_transform(regexp_extract_all(trim(text, ' '), '\\p{L}+|[^\\p{L}]+'),
  lambda e: replace(upper(e[1]), 'ẞ', 'Ss') || lower(e[2:])), '')) as name_hash from documents""",
    "fill_group_mean": f"""select event_id, {each("round(coalesce(r.{c}, w.{c}), 6) as {c}", POLLUTANTS)}
from readings r left join weeks w on r.site = w.site and r.yr = w.yr and r.wk = w.wk""",
    "classify_nearest": f"select reading_id, {GRADES} from cohort_rows",
    "row_mean": f"select reading_id, round(class_mean, 6) as class_mean from (select *, {CLASS_MEAN} from (select reading_id, {GRADES} from cohort_rows))",
    "pct_change": f"select site, {rnd(POLLUTANTS)} from variation",
    "cast_class": "select site, dt, cast(trunc(class_mean) as int) as label from daily",
    "abs_sqrt": """select o_orderkey, round(size, 6) as size, round(sqrt(size), 6) as root
from (select o_orderkey, abs(o_totalprice / 9973e0 - 20) as size from orders)""",
    "impute_mean": impute_sql("avg({c}) over (partition by site)") + "adv",
    "feature_set_base": f"select site, dt, {rnd(feature_set_base())} from model",
    "feature_set_adv": f"select site, dt, {rnd(ADV[:-2])}, month, weekday from adv",
    "fold_contiguous": "select site, dt, cast(ntile(3) over (partition by site order by dt) - 1 as int) as fold from model",
    "fold_expanding": f"select site, dt, fold, role from ({expanding('model', 5)})",
    "fold_skip_single_class": """select f.site, f.dt, f.so2_cls, f.fold, f.role from class_folds f
join kept_folds k on k.site = f.site and k.fold = f.fold and k.target = 'so2_cls'""",
    "m_mae": "select site, target, round(avg(abs(y - p)), 6) as value from persistence group by site, target",
    "m_rmse": "select site, target, round(sqrt(avg((y - p) ** 2)), 6) as value from persistence group by site, target",
    "m_r2": """select site, target, round(case when total = 0 then case when residual = 0 then 1 else 0 end else 1 - residual / total end, 6) as value
from (select a.site, a.target, sum((y - p) ** 2) as residual, sum((y - mean) ** 2) as total from persistence a
  join (select site, target, avg(y) as mean from persistence group by site, target) b on a.site = b.site and a.target = b.target
  group by a.site, a.target)""",
    "m_accuracy": "select site, target, round(avg(cast(y = p as int)), 6) as value from class_persistence group by site, target",
    "m_fold_mean": """select site, target, round(avg(value), 6) as value from (
  select site, target, fold, avg(cast(y = p as int)) as value from class_persistence group by site, target, fold)
group by site, target""",
    "forecast_status": "select site, case when count(*) >= 7 then 'ok' else 'short' end as status from model group by site",
}


def grid_sql():
    body = f"""
tested as ({expanding("(select * from long_rows where lag2 is not null)", 3, "site, target")}),
pred as (select site, target, fold, y, candidate, params, lag1 * w + lag2 * (1 - w) as p from tested,
  (values (0, '1.0', 1.0e0), (1, '0.7', 0.7e0), (2, '0.5', 0.5e0)) v(candidate, params, w) where role = 'test'),
means as (select site, target, candidate, params, avg(mae) as mean_mae from (
  select site, target, candidate, params, fold, avg(abs(y - p)) as mae from pred group by all) group by all)
select site, target, params, candidate, round(mean_mae, 6) as mean_mae from means
qualify row_number() over (partition by site, target order by mean_mae, candidate) = 1"""
    return with_more(body)


HELD_OUT = """
days as (select dt, row_number() over (order by dt) as place, count(*) over () as n from (select distinct dt from model)),
cut as (select min(dt) as first from days where place > n - ceil(n * 0.2)),
long as ({rows})"""


def held_out(targets):
    """Common table expressions: rows by target, and the first of the last fifth of all days."""
    return HELD_OUT.format(rows=" union all ".join(f"select dt, '{t}' as target, cast({t} as double) as y from model" for t in targets))


def regressed_sql(model):
    """What a regression is asked about; what it has to fulfil stands as constants."""
    return with_more(f"""{held_out(TARGETS)}
select target, '{model}' as model, count(*) as n_rows, round(sum(y), 4) as sum_y, 0 as n_unanswered, true as in_range, true as beats_mean
from long, cut where dt >= first group by target""")


def classified_sql(model):
    """The same for classes; the commonest class of the training rows is the mark to beat."""
    return with_more(f"""{held_out(CLASS_COLUMNS)},
learnt as (select target, y, count(*) as n from long, cut where dt < first group by all),
usual as (select target, y as usual from learnt qualify row_number() over (partition by target order by n desc, y) = 1
  and count(*) over (partition by target) > 1)
select target, '{model}' as model, count(*) as n_rows, cast(sum(y) as bigint) as sum_y, count(*) filter (y = usual) as n_usual,
  0 as n_foreign, true as beats_majority
from long join usual using (target), cut where dt >= first group by target""")


def of_sites_sql(by_target=True):
    """Test days of the folds with two classes; the commonest class of a site's training days is the mark to beat."""
    shown, by = ("target, ", " group by target") if by_target else ("", "")
    return with_more(f"""
counts as (select site, fold, target, label, count(*) as n from class_long where role = 'train' group by all),
usual as (select site, fold, target, label as usual from counts
  qualify row_number() over (partition by site, fold, target order by n desc, label) = 1)
select {shown}count(*) as n_rows, cast(sum(label) as bigint) as sum_y, count(*) filter (label = usual) as n_usual,
  0 as n_foreign, true as beats_majority
from class_long join kept_folds using (site, fold, target) join usual using (site, fold, target) where role = 'test'{by}""")


KNN_PAIRS = """
sizes as (select site, fold, count(*) filter (role = 'test') as asked, count(*) filter (role = 'train') as known from class_folds group by all)
select site, cast(sum(asked * known) as bigint) as n_pairs, true as bounded from sizes group by site"""


def results_sql():
    """Accuracy and weighted F1 per fold from the answers of both classifiers, then the mean over folds."""
    return f"""
with answers as (select *, 'NaiveBayes' as model from ({bayes_sql()}) union all select *, 'KNN' from ({knn_sql()})),
accuracy as (select target, model, fold, avg(cast(y = p as int)) as value from answers group by all),
f1 as (select target, model, fold, sum(f1 * pos) / sum(pos) as value from (
  select target, model, fold, cls, sum(pos) as pos, 2e0 * sum(tp) / (sum(pos) + sum(named)) as f1 from (
    select target, model, fold, y as cls, 1 as pos, 0 as named, cast(y = p as int) as tp from answers
    union all select target, model, fold, p, 0, 1, 0 from answers)
  group by all) group by all)
select a.target, a.model, round(avg(a.value), 6) as accuracy, round(avg(f.value), 6) as f1, 'ok' as status
from accuracy a join f1 f on a.target = f.target and a.model = f.model and a.fold = f.fold group by a.target, a.model"""


def oracles():
    out = {name: statement(body) for name, body in PLAIN.items()}
    ar = lambda body: with_more("\n" + AR + "\n" + body)
    out["ar_lags"] = ar(f"select site, dt, {rnd(['class_mean', *[f'lag{i}' for i in range(1, 8)]])} from ar")
    out["real_vs_pred"] = ar("select site, dt, round(class_mean, 6) as y, round(lag1, 6) as p from ar")
    out["ar_gram"] = ar(gram_sql())
    out["split_chrono"] = with_more(f"\n{SPLIT.format(source='model')}\nselect site, dt, role from split")
    out["impute_mean_strict"] = with_more(
        f"\n{SPLIT.format(source='adv')}\n"
        + impute_sql("avg({c}) filter (role = 'train') over (partition by site)", "role, ")
        + "split"
    )
    daily_all = f"select dt, {avg(POLLUTANTS)} from daily group by dt"
    out["box_stats"] = box_sql(f"({daily_all})")
    out["box_stats_cohort"] = box_sql("stacked", ("cohort",))
    out["box_outliers"] = outlier_sql()
    out["m_f1_weighted"] = f1_sql()
    out["grid_search"] = grid_sql()
    out["cls_naive_bayes"] = bayes_sql()
    out["cls_knn"] = knn_sql()
    out["forecast_recursive"] = forecast_sql()
    out["ar_fit"] = fit_sql()
    out["forecast_fitted"] = forecast_fitted_sql()
    out["ar_scores"] = fit_scores_sql()
    out["results_table"] = results_sql()
    for key in ("cls_logistic_sites", "cls_tree_sites", "cls_svm_sites"):
        out[key] = of_sites_sql(key != "cls_svm_sites")
    out["knn_pairs"] = with_more(KNN_PAIRS)
    out["ar_tube"] = ar("select site, count(*) as n_rows, round(sum(class_mean), 4) as sum_y, true as no_worse from ar group by site")
    out["forecast_tube"] = with_more("""
last as (select site, max(dt) as dt, count(*) as n from model group by site)
select site, 7::bigint as n_days, cast(dt + 1 as date) as first, cast(dt + 7 as date) as last, true as on_scale from last where n >= 8""")
    learners = {"reg_random_forest": "RandomForest", "reg_boosted": "GradientBoosting", "reg_boosted_leaves": "BestFirst", "reg_network": "Network"}
    for key, name in learners.items():
        out[key] = regressed_sql(name)
    for key, name in CLASSIFIER_QUERIES.items():
        out[key] = classified_sql(name)
    out["grid_search_fitted"] = "select * from (values " + ", ".join(
        f"('{t}', 'RandomForest', 'ok', true, true, true)" for t in TARGETS
    ) + ") v(target, model, status, from_grid, scored, beats_mean)"
    return out
