"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from postflow.plans.catalog import (
    ALL_TERMS, ANY_TERMS, BOX, CELL, CENTER, DATELINE_BOX, FROM, NEAR_TERMS, NEAREST, NEGATORS, PHRASE, RADIUS_KM, RANK_TERMS, SHARE, TAG, TALL_BOX, TO, WITHIN,
)
from postflow.functions.geo import EARTH_KM

POSTS = r"""
posts as (
  select d.doc_id as id,
         strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y') as created_at,
         concat(d.text, ' http://t.co/', d.doc_id, ' @u', d.doc_id % 97, ' #tag', d.doc_id % 13) as text,
         e.user_id as retweet_count,
         case when d.doc_id % 5 = 0 then null else cast((d.doc_id * 37) % 180 as double) - 89.5 end as lat,
         case when d.doc_id % 5 = 0 then null else cast((d.doc_id * 91) % 360 as double) - 179.5 end as lon,
         concat('tag', d.doc_id % 13) as h1,
         case when d.doc_id % 3 = 0 then concat('tag', d.doc_id % 7) end as h2
  from documents d left join events e on e.event_id = d.doc_id
),
enriched as (
  select id, retweet_count, lat, lon, h1, h2,
         strptime(substr(created_at, 5), '%b %d %H:%M:%S %z %Y') as instant,
         cast(epoch(strptime(substr(created_at, 5), '%b %d %H:%M:%S %z %Y')) as bigint) as created_epoch,
         case when h2 is null then h1 else h1 || ',' || h2 end as hashtags,
         case when h2 is null then 1 else 2 end as n_tags,
         regexp_replace(text, 'http\S+|@\S+|#\S+', '', 'g') as cleaned_text
  from posts
),
words as (
  select id, unnest(regexp_extract_all(lower(cleaned_text), '[\p{L}\p{N}]+')) as term from enriched
)"""

LEXICON = r"""
lexicon as (
  select term, cast(sign(sum(vote)) as integer) as polarity
  from (select distinct w.id, w.term, case when l.toxic = 1 then -7 else 1 end as vote
        from words w join labels l on l.doc_id = w.id)
  group by term having count(*) >= 3 and sum(vote) <> 0
)"""

SCORED = r"""
polarity as (
  select w.id, sum(x.polarity) as total
  from (select distinct id, term from words) w join lexicon x on x.term = w.term group by w.id
),
processed as (
  select e.*, cast(sign(coalesce(p.total, 0)) as integer) as sentiment_score
  from enriched e left join polarity p on p.id = e.id
)"""

TAGS = """
tags as (
  select distinct id, tag, sentiment_score
  from (select id, lower(h1) as tag, sentiment_score from processed
        union all select id, lower(h2), sentiment_score from processed where h2 is not null)
)"""

TF = "tf as (select term, id, count(*) as tf from words group by term, id)"

PLACES = r"""
places as (
  select id, unnest(t) as term, generate_subscripts(t, 1) as p
  from (select id, regexp_extract_all(lower(cleaned_text), '[\p{L}\p{N}]+') as t from enriched)
)"""

ENRICHED_COLUMNS = "id, created_epoch, lat, lon, hashtags, cleaned_text"
FLAT_COLUMNS = "id, created_epoch, lat, lon, hashtags, cleaned_text as text, sentiment_score"
BY_SENTIMENT = """count(*) filter (where sentiment_score > 0) as pos,
  count(*) filter (where sentiment_score = 0) as neutral,
  count(*) filter (where sentiment_score < 0) as neg,
  round(avg(sentiment_score), 6) as mean_score"""


def _with(query: str, *parts: str) -> str:
    return "with " + ",\n".join([POSTS, *parts]) + "\n" + query


def _scored(query: str, *parts: str) -> str:
    return _with(query, LEXICON, SCORED, *parts)


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _terms(terms: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _token_list() -> str:
    return r"regexp_extract_all(lower(cleaned_text), '[\p{L}\p{N}]+')"


def _between(start: str, end: str) -> str:
    return f"instant >= timestamptz '{start}+00' and instant < timestamptz '{end}+00'"


def _box(south, west, north, east) -> str:
    lon = f"lon between {west} and {east}" if west <= east else f"(lon >= {west} or lon <= {east})"
    return f"lat between {south} and {north} and {lon}"


def _phrase(words: list[str]) -> str:
    joins = " ".join(f"join places w{i} on w{i}.id = w0.id and w{i}.p = w0.p + {i} and w{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return _with(f"select w0.id, count(*) as hits from places w0 {joins} where w0.term = '{words[0]}' group by w0.id", PLACES)


def _near(terms: list[str], within: int) -> str:
    last = ", ".join(f"max(case when term = '{t}' then p end) over (partition by id order by p) as l{i}" for i, t in enumerate(terms))
    # `least` takes no account of nulls, so a term that has not come yet must be asked for.
    seen = " and ".join(f"l{i} is not null" for i in range(len(terms)))
    return _with(
        f"""select id, min(p - least({", ".join(f"l{i}" for i in range(len(terms)))}) + 1) as words
        from (select id, p, {last} from places where term in {_terms(terms)}) where {seen} group by id having words <= {within}""",
        PLACES,
    )


def _ranked(k: int) -> str:
    return _with(
        f"""select t.id, round(sum(t.tf * ln((n.n + 1) / (d.df + 1))), 6) as score
        from tf t join (select term, count(*) as df from tf group by term) d on d.term = t.term,
             (select count(*)::double as n from enriched) n
        where t.term in {_terms(RANK_TERMS)}
        group by t.id order by score desc, t.id limit {k}""",
        TF,
    )


_INDEX = "row_number() over (order by retweet_count nulls first, id) - 1"
_HISTOGRAM = "select (created_epoch // 21600) * 21600 as bucket_epoch, count(*) as posts, round(avg(sentiment_score), 6) as mean_score from processed group by 1"
_CELLS = f"cast(floor(lat / {CELL}) as bigint) as cell_lat, cast(floor(lon / {CELL}) as bigint) as cell_lon"
_REPLAY = f"""(select *, {_INDEX} as index from enriched) p join events e on e.event_id = p.index"""

ORACLE = {
    "post_hashtags": _with("select id, n_tags, hashtags from enriched"),
    "post_coordinates": _with("select id, lat, lon from enriched"),
    "clean_text": _with("select id, cleaned_text from enriched"),
    "parse_time": _with("select id, created_epoch from enriched"),
    "json_scan": _with(f"select {ENRICHED_COLUMNS} from enriched"),
    "json_rejects": """select '{"id":' || doc_id || ',"text":"cut' as line from documents""",
    "dense_index": _with(f"select id, retweet_count, {_INDEX} as index from enriched"),
    "replay_join": _with(f"select p.index, p.id, p.created_epoch, p.cleaned_text from {_REPLAY}"),
    "stream_replay": _with(f"select p.id, p.created_epoch, p.cleaned_text from {_REPLAY}"),
    "enrich_join": _with(
        "select f.id, h.hashtags, f.cleaned_text from enriched f join enriched h on h.id = f.id"
    ),
    "envelope_roundtrip": _with(f"select {ENRICHED_COLUMNS} from enriched"),
    "envelope_rejects": "select text as json from documents",
    "lexicon_terms": _with("select term, polarity from lexicon", LEXICON),
    "sentiment_lexicon": _scored(
        """select id, case sentiment_score when 1 then 'pos' when -1 then 'neg' else 'neutral' end as label
        from processed"""
    ),
    "sentiment_lexicon_joined": _scored(
        """select id, case sentiment_score when 1 then 'pos' when -1 then 'neg' else 'neutral' end as label
        from processed"""
    ),
    "sentiment_phrases": _with(
        """select e.id, case when t.total > 0 then 'pos' when t.total < 0 then 'neg' else 'neutral' end as label
        from enriched e left join (select id, sum(polarity * sign) as total from starts join entries using (phrase) group by id) t on t.id = e.id""",
        PLACES,
        f"""signed as (
          select *, case when max(case when term in {_terms(NEGATORS)} then p end)
            over (partition by id order by p rows between 3 preceding and 1 preceding) is null then 1 else -1 end as sign,
            lead(term) over (partition by id order by p) as after from places)""",
        """starts as (
          select id, term as phrase, sign from signed union all select id, term || ' ' || after, sign from signed where after is not null)""",
        """entries as (
          select phrase, sign(sum(vote)) as polarity
          from (select distinct s.id, s.phrase, case when l.toxic = 1 then -7 else 1 end as vote from starts s join labels l on l.doc_id = s.id)
          group by phrase having count(*) >= 3 and sum(vote) <> 0)""",
    ),
    "sentiment_score": _with(
        """select e.id, cast(sum(coalesce(x.polarity, 0)) as bigint) as score
        from enriched e left join words w on w.id = e.id left join lexicon x on x.term = w.term group by e.id""",
        LEXICON,
    ),
    "sentiment_model": _with(
        """select e.id,
          case when s.total > 0 then 'pos' when s.total < 0 then 'neg' else 'neutral' end as label,
          cast(sign(s.total) as integer) as sentiment_score
        from enriched e join (
          select e.id, any_value(b.bias) + coalesce(sum(m.polarity), 0) as total
          from enriched e cross join bias b left join (select distinct id, term from words) w on w.id = e.id
          left join bayes m on m.term = w.term group by e.id) s on s.id = e.id""",
        """learned as (select doc_id, toxic from labels join enriched on id = doc_id where (doc_id * 7919) % 4 <> 0),
        sizes as (select count(*) filter (where toxic = 1) as toxic, count(*) filter (where toxic = 0) as other from learned),
        bias as (select cast(round(ln((other + 1) / (toxic + 1)) * 1000000) as bigint) as bias from sizes),
        seen as (
          select term, count(*) filter (where l.toxic = 0) as good, count(*) filter (where l.toxic = 1) as bad
          from (select distinct id, term from words) w join learned l on l.doc_id = w.id group by term having count(*) >= 3),
        bayes as (
          select term, cast(round((ln((good + 100 * (good + bad) / (toxic + other)) / (other + 100))
            - ln((bad + 100 * (good + bad) / (toxic + other)) / (toxic + 100))) * 1000000) as bigint) as polarity
          from seen cross join sizes)""",
    ),
    "annotation_labels": _with(
        """select id, case when h1 = 'tag3' then 'neg' else 'pos' end
            || case when h2 is null then '' when h2 = 'tag3' then ',neg' else ',pos' end as labels,
          case when h1 = 'tag3' then -1 else 1 end + case when h2 is null then 0 when h2 = 'tag3' then -1 else 1 end as score
        from enriched"""
    ),
    "processed_posts": _scored(f"select {FLAT_COLUMNS} from processed"),
    "stream_processed_posts": _scored(f"select {FLAT_COLUMNS} from processed"),
    "compat_columns": _scored(
        """select strftime(make_timestamp(created_epoch * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as created_at,
        lat, lon, hashtags, cleaned_text as text, sentiment_score from processed"""
    ),
    "text_search_any": _with(
        f"select id from enriched where list_has_any({_token_list()}, {_list(ANY_TERMS)})"
    ),
    "text_search_all": _with(
        f"select id from enriched where list_has_all({_token_list()}, {_list(ALL_TERMS)})"
    ),
    "inverted_index": _with("select term, id, tf from tf", TF),
    "term_counts": _with("select term, count(*) as df from tf group by term", TF),
    "ranked_search": _ranked(50),
    "index_ranked_search": _ranked(50),
    "block_ranked_search": _ranked(50),
    "phrase_search": _phrase(PHRASE.split()),
    "near_search": _near(NEAR_TERMS, WITHIN),
    "index_search": _with(
        f"""select id from tf where term in {_terms(ALL_TERMS)}
        group by id having count(*) = {len(ALL_TERMS)}""",
        TF,
    ),
    "time_range": _with(f"select id, created_epoch from enriched where {_between(FROM, TO)}"),
    "bbox_search": _with(f"select id, lat, lon from enriched where {_box(*BOX)}"),
    "bbox_search_dateline": _with(f"select id, lat, lon from enriched where {_box(*DATELINE_BOX)}"),
    "box_search_curve": _with(f"select id, lat, lon from enriched where {_box(*TALL_BOX)}"),
    "nearest_posts": _with(
        f"""select center_id, rank, id, distance_km from (
          select c.id as center_id, p.id, p.distance_km, row_number() over (partition by c.id order by p.distance_km, p.id) as rank
          from (select id, lat, lon from enriched where lat is not null and id % 100 = 1) c, lateral (
            select id, round(2 * {EARTH_KM} * asin(sqrt(least(1, pow(sin(radians(e.lat - c.lat) / 2), 2)
              + cos(radians(e.lat)) * cos(radians(c.lat)) * pow(sin(radians(e.lon - c.lon) / 2), 2)))), 6) as distance_km
            from enriched e where e.lat is not null and e.id <> c.id) p)
        where rank <= {NEAREST}"""
    ),
    "radius_search": _with(
        f"""select id, round(km, 3) as distance_km from (
          select id, 2 * {EARTH_KM} * asin(least(1, sqrt(
            pow(sin(radians(lat - {CENTER[0]}) / 2), 2)
            + cos(radians({CENTER[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {CENTER[1]}) / 2), 2)
          ))) as km from enriched)
        where km <= {RADIUS_KM}"""
    ),
    "hashtag_search": _with(
        f"select id, hashtags from enriched where lower('{TAG}') in (lower(h1), coalesce(lower(h2), ''))"
    ),
    "hashtag_counts": _scored(
        "select tag as hashtag, count(*) as posts from tags group by tag order by posts desc, tag limit 10", TAGS
    ),
    "combined_search": _scored(
        f"""select {FLAT_COLUMNS} from processed
        where {_between(FROM, TO)} and {_box(*BOX)} and list_has_all({_token_list()}, {_list(ALL_TERMS[:2])})"""
    ),
    "combined_search_indexed": _scored(
        f"""select {FLAT_COLUMNS} from processed
        where {_between(FROM, TO)} and {_box(*BOX)} and list_has_all({_token_list()}, {_list(ALL_TERMS[:2])})"""
    ),
    "combined_search_bitmap": _scored(
        f"""select {FLAT_COLUMNS} from processed
        where {_between(FROM, TO)} and {_box(*BOX)} and list_has_all({_token_list()}, {_list(ALL_TERMS[:2])})"""
    ),
    "layout_search": _scored(
        f"select {FLAT_COLUMNS} from processed where {_between(FROM, TO)} and {_box(*DATELINE_BOX)}"
    ),
    "time_histogram": _scored(_HISTOGRAM),
    "stream_time_histogram": _scored(_HISTOGRAM),
    "tile_counts": _scored(
        "\nunion all\n".join(
            f"""select {level}::int as level, cast(floor(lat / {CELL * 2 ** level}) as bigint) as cell_lat,
            cast(floor(lon / {CELL * 2 ** level}) as bigint) as cell_lon, count(*) as posts, round(avg(sentiment_score), 6) as mean_score
            from processed where lat is not null group by 1, 2, 3"""
            for level in range(3)
        )
    ),
    "trending_hashtags": _scored(
        f"""select * from (
          select (created_epoch // 21600) * 21600 as bucket_epoch, tag as hashtag, count(*) as posts,
            (sum(count(*)) over (partition by (created_epoch // 21600) * 21600))::bigint as uses
          from (select distinct id, tag from tags) t join processed using (id) where created_epoch is not null group by 1, 2)
        where posts >= {SHARE} * uses""",
        TAGS,
    ),
    "topic_start": _with(
        """select 'earliest' as start, id, created_epoch from enriched
        union all select 'half', id, created_epoch from enriched where id % 2 = 1"""
    ),
    "stream_sessions": _scored(
        """select hashtag, min(created_epoch) as start_epoch, max(created_epoch) + 1800 as end_epoch, count(*) as posts,
          round(avg(sentiment_score), 6) as mean_score
        from (select *, sum(head) over (partition by hashtag order by created_epoch, id rows unbounded preceding) as run from (
          select tag as hashtag, id, created_epoch, sentiment_score,
            case when created_epoch - lag(created_epoch) over (partition by tag order by created_epoch, id) <= 1800 then 0 else 1 end as head
          from (select distinct id, tag from tags) t join processed using (id) where created_epoch is not null))
        group by hashtag, run""",
        TAGS,
    ),
    "grid_counts": _scored(
        f"""select {_CELLS}, count(*) as posts, round(avg(sentiment_score), 6) as mean_score
        from processed where lat is not null group by 1, 2"""
    ),
    "sentiment_by_hashtag": _scored(f"select tag as hashtag, {BY_SENTIMENT} from tags group by tag", TAGS),
    "sentiment_by_day": _scored(
        f"""select strftime(make_timestamp(created_epoch * 1000000), '%Y-%m-%d') as day, {BY_SENTIMENT}
        from processed group by 1"""
    ),
    "sentiment_by_cell": _scored(
        f"select {_CELLS}, {BY_SENTIMENT} from processed where lat is not null group by 1, 2"
    ),
}
