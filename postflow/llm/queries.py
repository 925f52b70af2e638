"""The registered queries of this subpackage, each its operator over a whole table, and their SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflow.llm import (
    centroids, chat, fingerprint, jaccard, language, lengths, merkle, mixing, neighbours, packing, quality, sharding, suffixes,
)
from postflow.llm.support import on_path, read

BOTH = "</s>[INST] ok [/INST]"  # a conversation of control strings only


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", BOTH), (-1, 1, "assistant", BOTH)], turns.schema)
    parts = turns.unionByName(tricky).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    done = chat.format_chat(parts)
    turns_text = F.array_join(
        F.transform(
            chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
        ),
        "",
    )
    masked = chat.read_masked(F.col("formatted"), F.col("turn_starts"), F.col("loss_mask"))
    return done.select("conv_id", "n_turns", "formatted", "formatted_chars", masked.alias("_masked")).select(
        "conv_id", "n_turns",
        F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("_masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_totals(lengths.length_histogram(read(spark, sf_dir, "documents")))


def remainder(n: int):
    """Of the CRC of the id as text; -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = language.fit_languages(documents, learn=remainder(3) != 1)
    found = language.identify_languages(documents, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(read(spark, sf_dir, "documents"))


# Fixed values of the mixture: three domains by the number of the source, and target weights.
DOMAIN = "case try_cast(substring(source, 4) as int) % 3 when 0 then 'web' when 1 then 'books' else 'notes' end"
DOMAIN_WEIGHT = "case domain when 'web' then 3.0 when 'books' then 2.0 else 1.0 end"
LANG_WEIGHT = "case lang when 'en' then 4.0 else 2.0 end"


def mixture(documents: DataFrame, share: float, max_epochs: int, name: str = "copies") -> DataFrame:
    return mixing.mix_copies(
        documents,
        levels={"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")},
        weights={"domain": F.expr(DOMAIN_WEIGHT), "lang": F.expr(LANG_WEIGHT), "source": F.lit(1.0)},
        tokens=F.ceil(F.octet_length("text") / 4),
        share=share,
        max_epochs=max_epochs,
        seed=17,
        name=name,
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(read(spark, sf_dir, "documents"), share=1.0, max_epochs=3)
    tokens = F.coalesce(F.ceil(F.octet_length("text") / 4), F.lit(0)).cast("long")
    return mixed.select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", tokens.alias("tokens"), "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(packing.cut_documents(read(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    forest = quality.fit_quality(documents, labels, learn=remainder(5) != 0)
    scored = quality.score_quality(documents, forest)
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.build_manifest(read(spark, sf_dir, "documents"), claim=merkle.tampered_leaf())
    proved = merkle.prove(manifest, manifest.leaves)
    folded = proved.select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.fold(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def _importable(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_path(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    q.__name__: _importable(q)
    for q in (
        op1_chat_format, op2_token_counts, op3_language_id, op4_ngram_jaccard, op5_fingerprints, op6_source_mix,
        op7_sharding, op8_best_fit_packing, op9_quality, op10_nearest, op11_merkle_manifest, op12_suffix_dedup,
        op13_centroid_clusters,
    )
}

_ESCAPED = r"coalesce({}, '')"
for _found, _put in [("\\", "\\e"), *[(c, chat.ESCAPE + chat.CODES[c[0]] + c[1:]) for c in chat.CONTROL]]:
    _ESCAPED = f"replace({_ESCAPED}, '{_found}', '{_put}')"

_SHINGLES = """list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}, '-')"
_LEAF = "sha256({})".format(" || ".join(_FIELD.format(c) for c in merkle.FIELDS))
_CLAIM = "sha256({})".format(
    " || ".join(_FIELD.format(c) for c in [*merkle.FIELDS[:-1], f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"])
)
# The CRC of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda r, z: xor(r >> 1, case when r & 1 = 1 then 3988292384::ubigint else 0::ubigint end))))"""


def _climb(name: str, group: str, levels: int) -> str:
    """CTEs `<name>1`, ... of nodes (group, pos, d, kids) from `<name>0` (group, pos, d); a single node stays as it is."""
    return ",".join(f"""
        {name}{n + 1} as (select {group}, pos // 16 as pos, list(d order by pos) as kids, bool_or(m > 1) as run,
            case when bool_or(m > 1) then sha256(string_agg(d, '' order by pos)) else any_value(d) end as d
            from (select *, count(*) over (partition by {group}) as m from {name}{n}) group by {group}, pos // 16)""" for n in range(levels))


def _walk(name: str, before: str, climb: str, group: str, rank: str, levels: int) -> str:
    """CTEs that lead every row of `before` up one tree, adding siblings and folding its claim."""
    out = []
    for n in range(levels):
        left = f"coalesce(array_to_string(k.kids[1:({rank} >> {4 * n}) & 15], ''), '')"
        right = f"coalesce(array_to_string(k.kids[(({rank} >> {4 * n}) & 15) + 2:], ''), '')"
        out.append(f"""
        {name}{n + 1} as (select w.* exclude (folded, proof), case when k.run then sha256({left} || folded || {right}) else folded end as folded,
            case when k.run then proof || {left} || {right} else proof end as proof
            from {before if n == 0 else f'{name}{n}'} w join {climb}{n + 1} k on k.{group} is not distinct from w.{group} and k.pos = w.{rank} >> {4 * n + 4})""")
    return ",".join(out)


_SOURCE_LEVELS, _TOP_LEVELS = 8, 4


def _rounds(n: int) -> str:
    """CTEs of the centroids after each round and the last assignment."""
    out = []
    for r in range(n + 1):
        out.append(f"""
        near{r} as materialized (select vec_id, row, v, min(struct_pack(distance, num)) as best from (
            select a.vec_id, a.row, a.v, c.num, list_sum(list_transform(list_zip(a.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
            from kept a cross join cent{r} c) group by all)""")
        if r < n:
            out.append(f"""
        sums{r} as (select num, i, sum(x)::hugeint as s, count(*)::hugeint as n
            from (select best.num as num, unnest(v) as x, generate_subscripts(v, 1) as i from near{r}) group by num, i),
        mean{r} as (select num, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from sums{r} group by num),
        cent{r + 1} as materialized (select o.num, coalesce(m.c, o.c) as c from cent{r} o left join mean{r} m using (num))""")
    return ",".join(out)


ORACLE = {
    "op11_merkle_manifest": f"""
        with leaves as (select doc_id, source, {_LEAF} as leaf,
            case when ({_CRC}) % 5 = 0 then {_CLAIM} end as claim from documents),
        placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as rank from leaves),
        a0 as (select source, rank as pos, leaf as d from placed),{_climb('a', 'source', _SOURCE_LEVELS)},
        subs as (select source, d as subroot, row_number() over (order by source nulls first) - 1 as s, 0 as g from a{_SOURCE_LEVELS}),
        b0 as (select g, s as pos, subroot as d from subs),{_climb('b', 'g', _TOP_LEVELS)},
        w0 as (select p.doc_id, p.source, p.rank, p.leaf, u.subroot, u.s, u.g, coalesce(claim, leaf) as folded, '' as proof
            from placed p join subs u on u.source is not distinct from p.source),
        {_walk('w', 'w0', 'a', 'source', 'rank', _SOURCE_LEVELS)},
        {_walk('x', f'w{_SOURCE_LEVELS}', 'b', 'g', 's', _TOP_LEVELS)}
        select doc_id, leaf, subroot, d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = d as verified
        from x{_TOP_LEVELS} cross join b{_TOP_LEVELS}""",
    "op4_ngram_jaccard": f"""
        with recursive words as (select doc_id, {_SHINGLES.format("coalesce(text, '')")} as w from documents),
        sets as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) <= 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
        shingles as materialized (select doc_id, unnest(s) as x from sets),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by all),
        links as materialized (select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b
            where 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
        both_ways as materialized (select a, b from links union all select b, a from links),
        reached(doc_id, root) as (select doc_id, doc_id from sets union select b, root from reached join both_ways on a = doc_id)
        select doc_id, len(s)::bigint as n_shingles, component_id
        from sets join (select doc_id, min(root) as component_id from reached group by doc_id) using (doc_id)""",
    "op12_suffix_dedup": """
        with docs as materialized (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
        places as (select row, h, unnest(range(0, n - 199)) as p from docs where n >= 200),
        twice as (select row, p from (select row, p, count(*) over (partition by k) as times from (
            select row, p, md5_number(substr(h, 2 * p + 1, 400)) as k from places)) where times > 1),
        spans as (select row, min(p) as a, max(p) + 200 as b from (
            select row, p, sum(head) over (partition by row order by p) as run from (
                select row, p, case when p > lag(p, 1, -201) over (partition by row order by p) + 200 then 1 else 0 end as head from twice))
            group by row, run),
        cuts as (select row, list_prepend(0, list(b order by a)) as ends, list(a order by a) as starts, sum(b - a)::bigint as gone, count(*) as n_spans
            from spans group by row)
        select doc_id, n as n_bytes, coalesce(gone, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
            sha256(unhex(case when gone is null then h else array_to_string(list_transform(list_zip(ends, list_append(starts, n)),
                lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') end)) as kept_sha256
        from docs left join cuts using (row)""",
    "op13_centroid_clusters": f"""
        with kept as materialized (select vec_id, row_number() over () as row,
            list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        cent0 as materialized (select num, v as c from (
            select v, row_number() over (order by sha256('3:' || vec_id), v) - 1 as num from kept) where num < 8),
        {_rounds(centroids.ROUNDS)}
        select vec_id, best.num::int as cluster, best.distance as distance,
            sum(best.distance) over (partition by best.num)::bigint as cluster_inertia, sum(best.distance) over ()::bigint as inertia,
            sha256(array_to_string(c, ',')) as centroid_sha256
        from near{centroids.ROUNDS} join cent{centroids.ROUNDS} on num = best.num""",
    "op1_chat_format": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '{BOTH}' union all select -1, 1, 'assistant', '{BOTH}')
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum({len(chat.TURN + chat.SEP + chat.END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::bigint
                as formatted_chars
        from turns group by conv_id""",
    "op5_fingerprints": f"""
        with texts as (select doc_id, coalesce(text, '') as text from documents),
        words as (select doc_id, text, length(text) as n, coalesce(lead(text) over o, first_value(text) over o) as next_text
            from texts window o as (order by doc_id desc rows between unbounded preceding and unbounded following)),
        edited as (select *, substring(text, 1, n - n // 3) || substring(next_text, 1, n // 3) as changed from words),
        split as (select doc_id, n, changed, unnest([1, 2, 3]) as part,
            unnest([{', '.join(_SHINGLES.format(c) for c in ('text', 'changed', 'next_text'))}]) as w from edited),
        shingled as (select doc_id, n, changed, part, case when len(w) = 0 then [] when len(w) <= 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end as s from split),
        hashed as (select * exclude (s), list_transform(s, lambda x: substring(md5(x), 1, 16)) as h from shingled),
        kept as (select * exclude (h), list_distinct(h) as h, list_filter(list_distinct(h), lambda x: x < '{fingerprint.KEEP}') as f, list_min(h) as least from hashed),
        wide as (select doc_id, any_value(n) as n, any_value(changed) as changed,
            {', '.join(f"any_value({c}) filter (part = {i}) as {c}{i}" for c in ('h', 'f', 'least') for i in (1, 2, 3))} from kept group by doc_id),
        met as (select *, {', '.join(f"case when len(f1) > 0 and len(f{i}) > 0 then f1 else h1 end as x{i}, case when len(f1) > 0 and len(f{i}) > 0 then f{i} else h{i} end as y{i}" for i in (2, 3))} from wide),
        counted as (select *, {', '.join(f"len(list_intersect(x{i}, y{i})) as z{i}" for i in (2, 3))} from met)
        select doc_id, n as n_chars, sha256(changed) as edited_sha256,
            {', '.join(f"coalesce(array_to_string(list_sort(list_distinct(list_concat(f{i}, case when least{i} is null then [] else [least{i}] end))), ''), '') as {c}" for i, c in ((1, 'fingerprint'), (2, 'edited_fingerprint')))},
            {', '.join(f"case when len(x{i}) + len(y{i}) = 0 then 1.0 when least(len(x{i}), len(y{i})) = 0 then 0.0 else z{i} / least(len(x{i}), len(y{i})) end::double as near_{c}" for i, c in ((2, 'edited'), (3, 'next')))},
            {', '.join(f"case when len(x{i}) + len(y{i}) = 0 then 1.0 else z{i} / (len(x{i}) + len(y{i}) - z{i}) end::double as resembles_{c}" for i, c in ((2, 'edited'), (3, 'next')))}
        from counted""",
    "op6_source_mix": f"""
        with docs as (select doc_id, {DOMAIN} as domain, lang, source, coalesce(ceil(strlen(text) / 4), 0)::bigint as tokens from documents),
        leaf as (select domain, lang, source, sum(tokens)::bigint as available, {DOMAIN_WEIGHT} as dw, {LANG_WEIGHT} as lw, 1.0 as sw
            from docs group by all),
        l3 as (select domain, lang, source, (available * 3)::double as cap, sw::double as w, available, dw, lw from leaf),
        l2 as (select domain, lang, sum(cap) as cap, any_value(lw)::double as w from l3 group by domain, lang),
        l1 as (select domain, sum(l2.cap) as cap, any_value({DOMAIN_WEIGHT})::double as w from l2 group by domain),
        root as (select least(sum(cap), (select sum(available)::double from leaf)) as budget from l1),
        f1 as (select domain, cap, w, (budget - coalesce(sum(cap) over (order by cap / w, domain rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, domain rows between current row and unbounded following) as water from l1, root),
        b1 as (select domain, least(cap, w * max(water) over ()) as budget from f1),
        f2 as (select domain, lang, cap, w, (budget - coalesce(sum(cap) over (partition by domain order by cap / w, lang rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (partition by domain order by cap / w, lang rows between current row and unbounded following) as water from l2 join b1 using (domain)),
        b2 as (select domain, lang, least(cap, w * max(water) over (partition by domain)) as budget from f2),
        f3 as (select domain, lang, source, available, cap, w,
            (budget - coalesce(sum(cap) over (partition by domain, lang order by cap / w, source rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (partition by domain, lang order by cap / w, source rows between current row and unbounded following) as water
            from l3 join b2 using (domain, lang)),
        b3 as (select domain, lang, source, available, least(cap, w * max(water) over (partition by domain, lang)) as budget from f3),
        plan as (select *, floor(budget / available)::bigint as epochs, budget - floor(budget / available) * available as rest from b3),
        placed as (select doc_id, domain, lang, source, tokens, epochs, rest, md5('17|' || epochs || '|' || doc_id) as place
            from docs join plan using (domain, lang, source)),
        summed as (select *, sum(tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row) as upto from placed)
        select doc_id, domain, lang, source, tokens, (epochs + case when upto <= rest then 1 else 0 end)::bigint as copies from summed""",
}
