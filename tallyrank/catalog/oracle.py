"""DuckDB SQL for the registered queries, written from the definition of each result."""

from __future__ import annotations

import random

from tallyrank.catalog.fixtures import (
    BOOSTED, CTE, DEFAULT, DRAWS, FOLDS, GROUP_TERM, ROUNDS, SEARCH_ROUNDS, SEED, SOURCE_TERMS, TERMS, TEXT_TERMS,
    TURNS,
)
from tallyrank.ml.search import BOOST_LOSSES, BOOST_RATES, BOOST_ROUNDS
from tallyrank.plans.charts import LABELS

SQL: dict[str, str] = {}


def _with(body: str, *views: str, **extra: str) -> str:
    parts = {v: CTE[v] for v in views} | extra
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + "\n" + body


def _has(column: str, term: str) -> str:
    return f"coalesce(contains(lower({column}), '{term.lower()}'), false)::int"


def _any(column: str, terms) -> str:
    return f"greatest({', '.join(_has(column, t) for t in terms)}, 0)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _odds(matched: str, unmatched: str) -> str:
    return (
        f"round(case when {unmatched} = 0 then null else {matched}::double / {unmatched} end, 6) as odds, "
        f"({unmatched} = 0)::bigint as odds_infinite"
    )


TOPIC = " + ".join(_has("txt", t) for t in TERMS.topic)
SONG = f"{_any('txt', TERMS.song_text)} + {_any('who', TERMS.song_name)}"
TOP = len(TERMS.topic)
IN_GROUP = f"coalesce(contains(who, '{GROUP_TERM}'), false)"

SQL["scan_csv"] = """
select o_orderkey as id,
  case when o_orderkey % 9 = 0 then null
       else concat('say "', o_orderpriority, '",', chr(10), o_orderstatus) end as note,
  case when o_orderkey % 8 = 0 or o_orderkey % 11 = 0 then null else o_totalprice end as price,
  cast(o_orderdate as date) as day
from orders"""

SQL["scan_csv_lenient"] = """
select o_orderkey as id, concat('a "', o_orderpriority, '" b') as txt,
  case when o_orderkey % 7 = 0 then null else o_orderkey % 100 end as n
from orders where o_orderkey % 11 <> 0"""

SQL["year_cycle_flag"] = _with(
    "select id, (coalesce(year(air_date) % 4 = 0, false))::bigint as cycle_year from items", "items"
)

_NUMBERED = """select doc_id, source, unnest(a) as line, generate_subscripts(a, 1) - 1 as line_no
from (select doc_id, source, string_split(text, chr(10)) as a from documents)"""
SQL["contains_flag"] = _with(
    "select doc_id, line_no::bigint as line_no, "
    + ", ".join(f"{_has('line', t)}::bigint as has_{t}" for t in TEXT_TERMS) + ", "
    + ", ".join(f"{_has('source', t)}::bigint as from_{t}" for t in SOURCE_TERMS)
    + " from numbered", numbered=_NUMBERED,
)

SQL["contains_complement"] = _with(
    "select item_id, who, "
    + ", ".join(f"(1 - {_has('who', t)})::bigint as not_{t}" for t in TERMS.names)
    + " from lines", "lines",
)

_PROSE = " + ".join(_has("line", t) for t in TEXT_TERMS)
_KEYWORDS = f"""
select 'lines' as source, item_id as key, ({TOPIC})::bigint as score, {TOP} as top from lines
union all select 'text_lines', doc_id, ({_PROSE})::bigint, {len(TEXT_TERMS)} from text_lines"""
SQL["keyword_score"] = _with(
    "select source, key, score from keywords", "lines", "text_lines", keywords=_KEYWORDS
)
SQL["keyword_score_negated"] = _with(
    """select source, key, sum(score)::bigint as score, sum(top - score)::bigint as score_negated
from keywords group by source, key""", "lines", "text_lines", keywords=_KEYWORDS,
)


def _odds_rows(view: str, key: str, column: str, terms) -> str:
    return f"""
select {key}, term, sum(hit)::bigint as matched, sum(1 - hit)::bigint as unmatched
from (select {key}, term, coalesce(contains(lower({column}), lower(term)), false)::int as hit
      from {view}, (select unnest({_list(terms)}) as term))
group by {key}, term"""


SQL["match_odds"] = _with(
    f"select doc_id, term, matched, unmatched, {_odds('matched', 'unmatched')} from hits",
    "text_lines", hits=_odds_rows("text_lines", "doc_id", "line", TEXT_TERMS),
)

SQL["composite_key"] = _with(
    """select request_id, concat(name, ' ', place, ' ', priority, ' ',
  case when lower(song) = 'true' then 'True' else 'False' end, ' ',
  case when lower(politics) = 'true' then 'True' else 'False' end) as preference
from requests""", "requests",
)

_COMPLETE = """select id, title, air_date, season, number_in_season, rating, image, link from items
where id is not null and title is not null and air_date is not null and season is not null
  and number_in_season is not null and rating is not null and image is not null and link is not null"""
SQL["dropna_any"] = _with(_COMPLETE, "items")

SQL["strided_sample"] = _with(
    """select case when position < 276 then 'early' when position < 600 then 'late' else 'rest' end as series,
  position, id, rating
from (select id, rating, row_number() over (order by id) - 1 as position from items)
where position % 4 = 0""", "items",
)

SQL["dedupe_keys"] = _with(
    "select distinct * from k where not (priority = 'Location' and song)", "requests",
    k="""select name, place, priority, lower(song) = 'true' as song, lower(politics) = 'true' as politics
from requests""",
)

SQL["speaking_lines"] = _with(
    """select item_id, who, place, speaking, words from lines
where item_id is not null and who is not null and place_id is not null and place is not null
  and txt is not null and speaking and words is not null""", "lines",
)

SQL["filtered_count"] = _with("select count(speaking) as n from lines where words >= 100", "lines")
SQL["long_rows"] = _with("select who, item_id, words from lines where words >= 100", "lines")

SQL["left_join_agg"] = _with(
    f"""select id, title, matched, unmatched from items left join (
  select item_id, sum({_has('who', GROUP_TERM)})::bigint as matched,
    sum(1 - {_has('who', GROUP_TERM)})::bigint as unmatched from lines group by item_id
) on id = item_id""", "items", "lines",
)

SQL["inner_join_titles"] = _with(
    """select a.id, a.viewers as views, a.rating, b.title
from items a join items b on a.id = b.id""", "items",
)

SQL["aligned_ratio"] = _with(
    f"""select item_id, part, whole,
  round(case when whole = 0 then null else part::double / whole end, 6) as ratio
from (select item_id, count(speaking) as part from lines where {IN_GROUP} group by item_id)
full join (select item_id, count(speaking) as whole from lines group by item_id) using (item_id)""",
    "lines",
)

GRID = f"""
select name, place, priority, song, politics
from (select unnest({_list(TERMS.names)}) as name), (select unnest({_list(TERMS.places)}) as place),
  (select unnest(['Characters', 'Location']) as priority),
  (select unnest([true, false]) as song), (select unnest([true, false]) as politics)"""

SQL["preference_grid"] = _with(
    """select grid.*,
  (select count(*) from lines where contains(lower(who), name)) as name_lines,
  (select count(*) from lines where contains(lower(place), grid.place)) as place_lines
from grid""", "lines", grid=GRID,
)

# --- ranking: the plain form, every preference ranked over every complete item ---

_SCORES = f"""
select item_id, count(*) as n_lines, sum({SONG}) as song_sum, sum({TOPIC}) as topic_sum
from lines group by item_id"""


def _ratio(matched: str, unmatched: str) -> str:
    return f"case when {unmatched} = 0 then 'infinity'::double else {matched}::double / {unmatched} end"


def _cascade(top: int) -> dict[str, str]:
    return {
        "complete": _COMPLETE,
        "scores": _SCORES,
        "names": _odds_rows("lines", "item_id", "who", TERMS.names),
        "places": _odds_rows("lines", "item_id", "place", TERMS.places),
        "grid": GRID,
        "pool": f"""
select g.*, c.id, c.rating,
  {_ratio('n.matched', 'n.unmatched')} as name_odds, {_ratio('p.matched', 'p.unmatched')} as place_odds,
  case when g.song then song_sum else 2 * n_lines - song_sum end as song_score,
  case when g.politics then topic_sum else {TOP} * n_lines - topic_sum end as topic_score
from complete c join scores s on c.id = s.item_id
join names n on n.item_id = c.id join places p on p.item_id = c.id
join grid g on g.name = n.term and g.place = p.term""",
        "cut1": """
select * from (select *, row_number() over (
  partition by name, place, priority, song, politics
  order by case when priority = 'Characters' then name_odds else place_odds end desc,
    case when priority = 'Characters' then place_odds else name_odds end desc, id) as r1 from pool)
where r1 <= 40 and place_odds <> 0""",
        "cut2": """
select * from (select *, row_number() over (
  partition by name, place, priority, song, politics order by song_score desc, id) as r2 from cut1)
where r2 <= 20 and name_odds <> 0""",
        "cut3": """
select * from (select *, row_number() over (
  partition by name, place, priority, song, politics order by topic_score desc, id) as r3 from cut2)
where r3 <= 5""",
        "best": f"""
select * from (select *, row_number() over (
  partition by name, place, priority, song, politics order by rating desc, id) as r4 from cut3)
where r4 <= {top}""",
    }


SQL["cascade_topk"] = _with(
    "select name, place, priority, song, politics, id, rating from best", "items", "lines", **_cascade(5)
)

_FILLED = ", ".join(
    f"coalesce({c}, {v!r}) as {c}" for c, v in DEFAULT.items()
)
_STORE = f"""
select name, place, priority, song, politics, {_FILLED}
from grid left join (
  select b.name, b.place, b.priority, b.song, b.politics, i.id, i.title, i.rating, i.image, i.link
  from best b join items i on i.id = b.id
) using (name, place, priority, song, politics)"""
SQL["recommend_all"] = _with(_STORE, "items", "lines", **_cascade(1))

SQL["lookup_join"] = _with(
    f"""select request_id, name, place, priority, song, politics, {_FILLED}
from (select request_id, name, place, priority, lower(song) = 'true' as song,
        lower(politics) = 'true' as politics from requests)
left join store using (name, place, priority, song, politics)""",
    "items", "lines", "requests", **_cascade(1), store=_STORE,
)

SQL["recommend_one"] = _with(
    f"""select id, rating, song_sum::bigint as song_score, topic_sum::bigint as topic_score, n_lines
from best join scores on item_id = id
where name = 'blue' and place = 'nation_1' and priority = 'Characters' and song and not politics""",
    "items", "lines", **_cascade(1),
)

SQL["option_lists"] = _with(
    f"""select 'name' as dimension, term as value from (select unnest({_list(TERMS.names)}) as term)
  where exists (select 1 from lines where contains(lower(who), term))
union all select 'place', term from (select unnest({_list(TERMS.places)}) as term)
  where exists (select 1 from lines where contains(lower(place), term))
union all select 'priority', unnest(['Characters', 'Location'])
union all select 'song', unnest(['False', 'True'])
union all select 'politics', unnest(['False', 'True'])""", "lines",
)

# --- aggregations ---

SQL["group_sum"] = _with(
    f"""select item_id, sum(words) as words, sum({_has('who', 'old')})::bigint as matched
from lines group by item_id""", "lines",
)
SQL["group_mean_max"] = _with(
    "select item_id, round(avg(words), 6) as mean_words, max(words) as max_words from lines group by item_id",
    "lines",
)
SQL["group_count_nonnull"] = _with(
    "select item_id, count(speaking) as n_speaking from lines group by item_id", "lines"
)
_SHARE = f"count(case when {IN_GROUP} then speaking end)::double / nullif(count(speaking), 0)"
SQL["conditional_share"] = _with(
    f"""select item_id, round(case when count(*) filter (where {IN_GROUP}) > 0 then {_SHARE} end, 6) as share,
  round({_SHARE}, 6) as share_or_zero from lines group by item_id""", "lines",
)
SQL["group_nunique"] = _with(
    "select item_id, count(distinct place_id) as n_places from lines group by item_id", "lines"
)
SQL["group_count_all"] = _with(
    """select item_id, count(who) as who, count(place_id) as place_id, count(place) as place,
  count(txt) as txt, count(speaking) as speaking, count(words) as words from lines group by item_id""",
    "lines",
)
SQL["group_cardinality"] = _with("select count(distinct item_id) as n_groups from lines", "lines")
SQL["global_min_max"] = _with(
    """select min(id) as min_id, max(id) as max_id, min(air_date) as min_air_date,
  max(air_date) as max_air_date, min(rating) as min_rating, max(rating) as max_rating from items""", "items",
)
SQL["metric_summary"] = _with(
    " union all ".join(
        f"""select '{c}' as metric, round_even(stddev_samp({c}), 1) as std, round_even(avg({c}), 1) as mean,
  round_even(quantile_cont({c}, 0.5), 1) as median, round_even(max({c}), 1) as max from items"""
        for c in ("viewers", "rating")
    ), "items",
)

_CLEAN = """
select id, air_date, season, number_in_season, viewers as views, rating, image, link,
  length(title)::bigint as title_len, (coalesce(year(air_date) % 4 = 0, false))::bigint as cycle_year
from items"""
SQL["describe"] = _with(
    " union all ".join(
        f"""select '{c}' as metric, count({c}) as count, round(avg({c}), 6) as mean,
  round(stddev_samp({c}), 6) as std, round(min({c})::double, 9) as min,
  round(quantile_cont({c}::double, 0.25), 9) as p25, round(quantile_cont({c}::double, 0.5), 9) as p50,
  round(quantile_cont({c}::double, 0.75), 9) as p75, round(max({c})::double, 9) as max from clean"""
        for c in ("id", "season", "number_in_season", "views", "rating", "title_len", "cycle_year")
    ), "items", clean=_CLEAN,
)
SQL["null_profile"] = _with(
    " union all ".join(
        f"select {i}::bigint as position, '{c}' as column_name, '{t}' as data_type, count({c}) as n_present from items"
        for i, (c, t) in enumerate((
            ("id", "bigint"), ("title", "string"), ("air_date", "date"), ("season", "bigint"),
            ("number_in_season", "bigint"), ("viewers", "double"), ("rating", "double"),
            ("image", "string"), ("link", "string"),
        ))
    ), "items",
)


def _histogram(column: str, bins: int) -> str:
    return f"""
select '{column}' as metric, b as bin, round(lo + b * ((hi - lo) / {bins}), 6) as low,
  round(lo + (b + 1) * ((hi - lo) / {bins}), 6) as high, coalesce(n, 0)::bigint as n
from (select min({column})::double as lo, max({column})::double as hi from clean),
  (select unnest(range({bins})) as b)
left join (
  select least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1})::bigint as hit, count(*) as n
  from clean, (select min({column})::double as lo, max({column})::double as hi from clean)
  where {column} is not null group by 1) on hit = b"""


SQL["histogram"] = _with(
    " union all ".join(_histogram(c, n) for c, n in (("rating", 30), ("views", 30), ("title_len", 40))),
    "items", clean=_CLEAN,
)
SQL["fixed_bins"] = _with(
    """select low, count(words) as n from (select unnest(range(0, 115, 5))::bigint as low)
left join lines on words >= low and words < low + 5 group by low""", "lines",
)
SQL["key_coverage"] = _with(
    """select min(item_id) as min_key, max(item_id) as max_key, max(item_id) - min(item_id) as span,
  count(distinct item_id) as n_keys,
  max(item_id) - min(item_id) + 1 - count(distinct item_id) as n_missing,
  (select count(*) from (select unnest(range((select min(item_id) from lines),
    (select max(item_id) from lines) + 1)) as k) where k not in (select item_id from lines)) as n_listed
from lines""", "lines",
)

SQL["missing_keys"] = _with(
    """select k as item_id from (select unnest(range((select min(item_id) from lines),
  (select max(item_id) from lines) + 1)) as k) where k not in (select item_id from lines)""", "lines",
)

# --- item tables ---

SQL["clean_items"] = _with("select * from clean", "items", clean=_CLEAN)

_LINE_FEATURES = f"""
select item_id, avg(words) as mean_words, max(words) as max_words,
  case when count(*) filter (where {IN_GROUP}) > 0 then {_SHARE} end as group_share,
  count(distinct place_id)::double as n_places
from lines group by item_id"""
_FEATURES = """
select clean.*, mean_words, max_words, group_share, n_places
from clean left join line_features on id = item_id"""
_FEATURE_VIEWS = {"clean": _CLEAN, "line_features": _LINE_FEATURES, "features": _FEATURES}

SQL["item_features"] = _with(
    """select * exclude (image, link) replace (round(mean_words, 6) as mean_words,
  round(group_share, 6) as group_share) from features""", "items", "lines", **_FEATURE_VIEWS,
)

IMPUTED_COLUMNS = ("rating", "group_share", "max_words", "mean_words", "n_places")
_IMPUTED = "select * replace ({}) from features".format(
    ", ".join(f"coalesce({c}, (select avg({c}) from features)) as {c}" for c in IMPUTED_COLUMNS)
)
SQL["impute_mean"] = _with(
    "select id, " + ", ".join(f"round({c}, 6) as {c}" for c in IMPUTED_COLUMNS) + " from imputed",
    "items", "lines", **_FEATURE_VIEWS, imputed=_IMPUTED,
)


def _next(column: str, order: str) -> str:
    return (
        f"coalesce({column}, first_value({column} ignore nulls) over "
        f"(order by {order} rows between current row and unbounded following))"
    )


SQL["backfill"] = _with(
    f"""select 'items' as source, id as key, air_date,
  (coalesce(year(air_date) % 4 = 0, false))::bigint as cycle_year,
  views, rating as value
from (select id, {_next('air_date', 'id')} as air_date, {_next('viewers', 'id')} as views,
        {_next('rating', 'id')} as rating from items)
union all select 'series', event_id, null, null, null, {_next('value', 'event_id')} from series""",
    "items", "series",
)
SQL["fill_zero"] = _with("select event_id, user_id, coalesce(value, 0) as value from series", "series")

SQL["topk"] = _with(
    """select season, id, rating, viewers, place from (
  select *, row_number() over (
    partition by season order by rating desc nulls last, viewers desc nulls last, id) as place from rated)
where place <= 5
union all select null, id, rating, viewers, place from (
  select *, row_number() over (order by rating desc nulls last, viewers desc nulls last, id) as place from rated)
where place <= 5""", "items",
    rated="select season, id, rating, viewers from items",
)

for _name, _column, _terms in (
    ("entity_ratio", "who", TERMS.names), ("location_ratio", "place", TERMS.places)
):
    SQL[_name] = _with(
        f"""select id, term, matched, unmatched, {_odds('matched', 'unmatched')}
from items left join hits on id = item_id""",
        "items", "lines", hits=_odds_rows("lines", "item_id", _column, _terms),
    )

for _name, _sum, _top in (("song", "song_sum", 2), ("topic", "topic_sum", TOP)):
    SQL[f"{_name}_score"] = _with(
        f"""select id, n_lines, {_sum}::bigint as {_name},
  ({_top} * n_lines - {_sum})::bigint as {_name}_negated
from items left join scores on id = item_id""", "items", "lines", scores=_SCORES,
    )

SQL["time_series"] = _with(
    """select x, id, 'rating' as series, rating as y from filled where x is not null
union all select x, id, 'views', views from filled where x is not null""", "items",
    filled=f"""select id, {_next('air_date', 'id')} as x, {_next('viewers', 'id')} as views,
  {_next('rating', 'id')} as rating from items""",
)
SQL["feature_target_pairs"] = _with(
    " union all ".join(
        f"select '{c}' as feature, id, round({c}::double, 6) as x, rating as y from features"
        for c in ("title_len", "mean_words", "group_share", "max_words")
    ), "items", "lines", **_FEATURE_VIEWS,
)

# --- rating models: the split and the nearest neighbours, by comparing all pairs ---

_BUCKET = "('0x' || substr(md5(cast(id as varchar)), 1, 8))::bigint % 100"
SQL["train_test_split"] = _with(
    f"select id, case when {_BUCKET} < 80 then 'train' else 'test' end as split from items", "items"
)

MODEL_FEATURES = (
    "id", "number_in_season", "title_len", "cycle_year", "mean_words", "max_words", "group_share", "n_places",
)
_TAGGED = f"select *, case when {_BUCKET} < 80 then 'train' else 'test' end as split from imputed"
_DISTANCE = " + ".join(f"pow(t.{f}::double - q.{f}::double, 2)" for f in MODEL_FEATURES)


def _near(asked: str) -> str:
    return f"""
select q.id as q_id, min({{'d': {_DISTANCE}, 'id': t.id, 'y': t.rating}}, 5) as best
from {asked} q, (select * from tagged where split = 'train') t group by q.id"""


_MODEL_VIEWS = {**_FEATURE_VIEWS, "imputed": _IMPUTED, "tagged": _TAGGED}
_NEIGHBOURS = """
select id, split, rating, list_avg(list_transform(best, lambda b: b.y)) as predicted
from tagged join near on q_id = id"""
_KNN_VIEWS = {**_MODEL_VIEWS, "near": _near("tagged"), "neighbours": _NEIGHBOURS}

SQL["knn_regress"] = _with(
    "select id, split, round(rating, 6) as rating, round(predicted, 6) as predicted from neighbours",
    "items", "lines", **_KNN_VIEWS,
)
SQL["rmse"] = _with(
    "select split, round(sqrt(avg(pow(rating - predicted, 2))), 6) as rmse from neighbours group by split",
    "items", "lines", **_KNN_VIEWS,
)
SQL["predicted_vs_actual"] = _with(
    "select id, round(rating, 6) as rating, round(predicted, 6) as predicted from neighbours",
    "items", "lines", **_KNN_VIEWS,
)
SQL["predicted_vs_actual_strided"] = _with(
    """select id, round(rating, 6) as rating, round(predicted, 6) as predicted, position
from (select *, row_number() over (order by id) - 1 as position from neighbours) where position % 4 = 0""",
    "items", "lines", **_KNN_VIEWS,
)
SQL["recommend_enriched"] = _with(
    f"""select name, place, priority, song, politics, {_FILLED},
  coalesce(round(list_avg(list_transform(best5, lambda b: b.y)), 6), 0) as predicted
from grid left join (
  select b.name, b.place, b.priority, b.song, b.politics, i.id, i.title, i.rating, i.image, i.link,
    near.best as best5
  from best b join items i on i.id = b.id join near on q_id = b.id
) using (name, place, priority, song, politics)""",
    "items", "lines", **_cascade(1), **_MODEL_VIEWS,
    near=_near("(select * from tagged where id in (select id from best))"),
)

# --- rating models on features of few values: every tree predicts its group's training mean ---

_GROUP = "number_in_season, cycle_year"
_MEANS = f"select {_GROUP}, avg(rating) as predicted from tagged where split = 'train' group by {_GROUP}"
_PURE_VIEWS = {
    **_MODEL_VIEWS, "means": _MEANS,
    "pure": f"select tagged.*, predicted from tagged join means using ({_GROUP})",
    "models": "select unnest(['forest', 'boosting', 'gradient_boosting']) as model",
}
SQL["models_group_mean"] = _with(
    "select model, id, split, round(predicted, 6) as predicted from pure, models", "items", "lines", **_PURE_VIEWS
)
SQL["comparison_group_mean"] = _with(
    """select model, split, round(sqrt(avg(pow(rating - predicted, 2))), 6) as rmse from pure, models
group by model, split""", "items", "lines", **_PURE_VIEWS,
)
_FOLD = "(('0x' || substr(md5(cast(id as varchar) || 'fold'), 1, 8))::bigint % 4)::int"
SQL["cv_folds"] = _with(f"select id, {_FOLD} as fold from items", "items")
SQL["cv_group_mean"] = _with(
    f"""select model as stage, 'cv' as split, round(sqrt(avg(mse)), 6) as rmse from (
  select t.fold, avg(pow(t.rating - m.predicted, 2)) as mse from folded t join (
    select f.fold, {_GROUP}, avg(rating) as predicted from folded o, (select unnest(range(4))::int as fold) f
    where o.fold <> f.fold group by f.fold, {_GROUP}
  ) m using (fold, {_GROUP.replace(', ', ',')}) group by t.fold), models group by model""",
    "items", "lines", **_PURE_VIEWS, folded=f"select *, {_FOLD} as fold from imputed",
)
# --- boosting round by round: a tree grown to purity predicts its group's weighted mean ---

def _boosted(settings: list[tuple[str, float, int]]) -> dict[str, str]:
    """Views: ``medians`` (s, part, group, predicted) of boosting with each of the settings (loss, rate,
    rounds) on each part of the training rows: those outside fold 0, 1, …, and (part -1) all of them."""
    values = ", ".join(f"({i}, '{loss}', {rate}::double, {rounds})" for i, (loss, rate, rounds) in enumerate(settings))
    sp = "partition by s, part"
    return {
        "settings": f"select * from (values {values}) v(s, loss, rate, rounds)",
        "folded": f"select *, {_FOLD} as fold from tagged",
        "parts": f"select unnest(range(-1, {FOLDS}))::int as part",
        # one row per group of equal rows; round 0 is the start
        "boost": f"""
  select s, loss, rate, rounds, part, {_GROUP}, rating as y, count(*)::double as w, 0 as round,
    null::double as predicted, null::double as tree_weight, true as going
  from folded, parts, settings where split = 'train' and fold <> part group by all
  union all
  select s, loss, rate, rounds, part, {_GROUP}, y,
    w * pow(mean_loss / (1 - mean_loss), (1 - lost) * rate) / sum(w) over ({sp}), round + 1, p,
    case when mean_loss <= 0 or mean_loss >= 0.5 then case when mean_loss <= 0 or round = 0 then 1.0 end
         else rate * ln((1 - mean_loss) / mean_loss) end,
    mean_loss > 0 and mean_loss < 0.5 and round + 1 < rounds
  from (select *, sum(w * lost) over ({sp}) / sum(w) over ({sp}) as mean_loss from (
    select *, case when largest = 0 then 0 when loss = 'linear' then e / largest
      when loss = 'square' then pow(e / largest, 2) else 1 - exp(-e / largest) end as lost from (
    select *, max(e) over ({sp}) as largest from (
    select *, abs(y - p) as e from (
    select *, sum(w * y) over ({sp}, {_GROUP}) / sum(w) over ({sp}, {_GROUP}) as p from boost where going)))))""",
        "trees": f"select distinct s, part, round, {_GROUP}, predicted, tree_weight from boost where tree_weight is not null",
        "medians": f"""
  select s, part, {_GROUP}, min(predicted) as predicted from (
    select *, sum(tree_weight) over ({sp}, {_GROUP} order by predicted, round rows unbounded preceding) as reached,
      sum(tree_weight) over ({sp}, {_GROUP}) as total from trees)
  where reached >= 0.5 * total * (1 - 1e-12) group by s, part, {_GROUP}""",
        "scores": f"""
  select s, part as fold, 1 - sum(pow(rating - predicted, 2)) / (var_pop(rating) * count(*)) as r2
  from folded f join medians m using ({_GROUP.replace(', ', ',')}) where split = 'train' and f.fold = m.part group by s, part""",
        "means": "select s, avg(r2) as r2 from scores group by s",
    }


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _drawn(turns: int, rounds: tuple[int, int] = SEARCH_ROUNDS) -> list[tuple[str, float, int]]:
    """The settings that a search draws, turn by turn."""
    found = []
    for turn in range(turns):
        source = random.Random(SEED + turn)
        for _ in range(DRAWS):
            found.append((source.choice(list(BOOST_LOSSES)), source.choice(list(BOOST_RATES)), source.randrange(*rounds)))
    return found


SQL["boosting_rounds"] = _recursive(_with(
    f"""select loss, id, round(predicted, 6) as predicted from tagged join medians using ({_GROUP}) join settings using (s)
where part = -1""", "items", "lines", **_MODEL_VIEWS, **_boosted([(loss, rate, ROUNDS) for loss, rate in BOOSTED]),
))
SQL["random_search"] = _recursive(_with(
    """select 0 as turn, s::int as draw, loss, rate, rounds::int as rounds, fold, round(scores.r2, 6) as r2,
  s = (select s from means order by r2 desc, s limit 1) as chosen
from scores join settings using (s)""", "items", "lines", **_MODEL_VIEWS, **_boosted(_drawn(1, BOOST_ROUNDS)),
))
SQL["retrain_until"] = _recursive(_with(
    f"""select turn::int as turn, round(rmse, 6) as rmse, rmse = min(rmse) over () as best from (
  select turn, sqrt(avg(pow(rating - predicted, 2))) as rmse
  from (select s // {DRAWS} as turn, s from means qualify row_number() over (partition by s // {DRAWS} order by r2 desc, s) = 1)
  join medians using (s) join tagged using ({_GROUP}) where part = -1 and split = 'test' group by turn)""",
    "items", "lines", **_MODEL_VIEWS, **_boosted(_drawn(TURNS)),
))

# --- boosting of the absolute error: leaves are lower medians of the groups' residuals ---

def _lower_median(value: str, weight: str, by: str) -> str:
    """The first value, in order, at which half of the weight of its group is reached."""
    return f"""min(case when {weight}_upto >= 0.5 * {weight}_all then {value} end) over (partition by {by})"""


def _median_rounds(rate: float) -> dict[str, str]:
    views = {
        "start": "select quantile_cont(rating, 0.5) as m from tagged where split = 'train'",
        "left0": f"""select {_GROUP}, rating - m as residual, count(*) as n, 0.0::double as score
from tagged, start where split = 'train' group by all""",
    }
    for i in range(1, ROUNDS + 1):
        views[f"ranked{i}"] = f"""select *, sum(n) over (partition by {_GROUP} order by residual rows unbounded preceding) as n_upto,
  sum(n) over (partition by {_GROUP}) as n_all from left{i - 1}"""
        views[f"step{i}"] = f"select *, {_lower_median('residual', 'n', _GROUP)} * {rate} as step from ranked{i}"
        views[f"left{i}"] = f"select {_GROUP}, residual - step as residual, n, score + step as score from step{i}"
    return views


SQL["absolute_rounds"] = _with(
    f"""select id, split, round(m + score, 6) as predicted
from tagged join (select distinct {_GROUP}, score from left{ROUNDS}) using ({_GROUP}), start""",
    "items", "lines", **_MODEL_VIEWS, **_median_rounds(0.3),
)
SQL["stack_group_mean"] = _with(
    """select id, title, season, views, round(pure.rating, 6) as rating, round(predicted, 6) as predicted
from pure join (select id, title from items) using (id)""", "items", "lines", **_PURE_VIEWS,
)
# --- a tree of three levels, split greedily by variance, and what its features gain ---

_SPLIT_BY = ("number_in_season", "cycle_year", "title_len")


def _grown_tree(depth: int) -> dict[str, str]:
    """Views ``splits`` (node, feature, rows, gain): at each level the best split of every node."""
    variance = "({q} / {n} - pow({s} / {n}, 2))"
    views = {"cells0": f"select 1::bigint as node, {', '.join(_SPLIT_BY)}, count(*)::double as n, sum(rating) as s, "
                       "sum(pow(rating, 2)) as q from tagged where split = 'train' group by all"}
    for level in range(depth):
        tried = " union all ".join(
            f"""select node, '{f}' as feature, x, n as rows, l_n, {variance.format(q='q', n='n', s='s')}
  - l_n / n * {variance.format(q='l_q', n='l_n', s='l_s')}
  - (n - l_n) / n * {variance.format(q='(q - l_q)', n='(n - l_n)', s='(s - l_s)')} as gain from (
  select node, {f} as x, sum(sum(n)) over upto as l_n, sum(sum(s)) over upto as l_s, sum(sum(q)) over upto as l_q,
    sum(sum(n)) over whole as n, sum(sum(s)) over whole as s, sum(sum(q)) over whole as q
  from cells{level} group by node, {f}
  window upto as (partition by node order by {f}), whole as (partition by node)) where l_n < n""" for f in _SPLIT_BY
        )
        views[f"splits{level}"] = f"""select * from ({tried}) where gain > 0
qualify row_number() over (partition by node order by gain desc) = 1"""
        value = " ".join(f"when '{f}' then {f}" for f in _SPLIT_BY)
        views[f"cells{level + 1}"] = f"""select node * 2 + (case feature {value} end > x)::bigint as node,
  {', '.join(_SPLIT_BY)}, n, s, q from cells{level} join splits{level} using (node)"""
    views["splits"] = " union all ".join(f"select node, feature, rows, gain from splits{i}" for i in range(depth))
    return views


SQL["tree_nodes"] = _with(
    "select feature, rows::bigint as rows, round(gain, 9) as gain from splits", "items", "lines", **_MODEL_VIEWS, **_grown_tree(3)
)
_LABELLED = " union all ".join(f"select '{f}' as feature, '{LABELS[f]}' as label" for f in _SPLIT_BY)
SQL["feature_shares"] = _with(
    f"""select feature, label, round(coalesce(sum(gain * rows), 0) / (select sum(gain * rows) from splits), 6) as importance
from ({_LABELLED}) left join splits using (feature) group by feature, label""",
    "items", "lines", **_MODEL_VIEWS, **_grown_tree(3),
)
SQL["recommend_choices"] = SQL["recommend_all"]
SQL["item_features_in_series"] = _with(
    """select * exclude (image, link) replace (round(mean_words, 6) as mean_words,
  round(group_share, 6) as group_share), id * 3 % 1009 as number_in_series from features""",
    "items", "lines", **_FEATURE_VIEWS,
)
SQL["recommend_stacked"] = _with(
    f"""select name, place, priority, song, politics, {_FILLED}, coalesce(round(predicted, 6), 0) as predicted
from grid left join (
  select b.name, b.place, b.priority, b.song, b.politics, i.id, i.title, i.rating, i.image, i.link, p.predicted
  from best b join items i on i.id = b.id join pure p on p.id = b.id
) using (name, place, priority, song, politics)""",
    "items", "lines", **_cascade(1), **_PURE_VIEWS,
)
SQL["predicted_vs_actual_stacked"] = _with(
    """select id, round(rating, 6) as rating, round(predicted, 6) as predicted, position
from (select *, row_number() over (order by id) - 1 as position from pure) where position % 4 = 0""",
    "items", "lines", **_PURE_VIEWS,
)
SQL["forest_chain"] = _with(
    """select id, round(log2(avg(pow(2.0, -(id % 60)) * (1 + id % 7 / 100)) over (partition by id % 60)), 6) as log_predicted
from items""", "items",
)
