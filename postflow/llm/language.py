"""Language ID by prediction by partial matching over bytes.

For each language a context tree holds how often each byte followed each context of up to three
bytes. A byte's code length is taken from its longest known context; from a context that never
saw it, an escape is paid and the next shorter one is asked, down to all bytes alike. Statistics
are frozen after fitting, so a code length depends only on the four bytes at hand, and the trees
become sorted tables that are searched for all positions of a batch at once.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postflow.llm.support import settle, slices, text_bytes

ORDER = 3  # bytes of context at most
START = 0  # stands before a text's first byte

# The limit on a language's bits a byte: so many times what this share of its texts stays below,
# and bits that any text may cost beyond it (about what an e-mail address and a key take).
MARGIN, USUAL, SPARE = 2.6, 0.75, 256
STEP = 1 / 4096  # bits a byte that rates are rounded to before they are counted
HELD_RUNS = 2 << 20  # different runs that a counting task holds


@dataclass(frozen=True)
class Bounds:
    """A smaller fit, if asked for: whole texts, chosen by a hash of their key. Without, all texts are learned.

    Every labelled language is learned. It has `texts` texts, or an equal share of `all_texts`
    (one at least) if there are many languages, each of at most `text_bytes` UTF-8 bytes; a
    language without any such text has its `long_texts` shortest ones. This bounds the model's
    size; nothing that is predicted is cut or left out.
    """

    texts: int = 400
    text_bytes: int = 64 << 10
    all_texts: int = 25_600
    long_texts: int = 2


@dataclass(frozen=True)
class ContextModel:
    """Code lengths in bits, a column per language, for every byte run of 1 to 4 bytes seen in fitting.

    `codes[n]` are sorted runs of n+1 bytes as numbers; `bits[n]` the cost of a run's last byte
    after the others; `escapes[n]` what it costs to leave the context that the run is. `none` is
    the cost of a byte no language has seen.
    """

    languages: list[str]
    codes: list[np.ndarray]
    bits: list[np.ndarray]
    escapes: list[np.ndarray]
    none: np.ndarray

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text in each language: texts x languages. A text's contexts begin anew."""
        total = np.zeros((len(starts) - 1, len(self.languages)))
        for a, b in slices(starts):
            if b - a > 1 or starts[b] - starts[a] <= 1 << 20:
                total[a:b] = self._slice(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], None)
                continue
            # One long text: pieces with the bytes before them as context.
            for at in range(int(starts[a]), int(starts[b]), 1 << 20):
                end = min(at + (1 << 20), int(starts[b]))
                lead = min(ORDER, at - int(starts[a]))
                total[a] += self._slice(data[at - lead:end], np.array([0, end - at + lead]), lead)[0]
        return total

    def _slice(self, data: np.ndarray, starts: np.ndarray, lead: int | None) -> np.ndarray:
        n = len(data)
        if not n:
            return np.zeros((len(starts) - 1, len(self.languages)))
        runs = _runs(data, starts)
        cost = np.zeros((n, len(self.languages)), np.float32)
        open_ = np.arange(n)
        for order in range(ORDER, -1, -1):
            at, known = _find(self.codes[order], runs[order][open_])
            cost[open_[known]] += self.bits[order][at[known]]
            open_ = open_[~known]
            if not len(open_):
                break
            if order:
                # The context is the run of one byte less that ends before this byte.
                context = runs[order][open_] >> np.uint32(8)
                at, known = _find(self.codes[order - 1], context)
                cost[open_[known]] += self.escapes[order - 1][at[known]]
            else:
                cost[open_] += self.none
        if lead:
            cost[:lead] = 0
        sums = np.zeros((len(starts) - 1, len(self.languages)))
        filled = np.flatnonzero(starts[1:] > starts[:-1])
        sums[filled] = np.add.reduceat(cost, starts[:-1][filled], axis=0, dtype=np.float64)
        return sums


def _runs(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each byte the number made of it and the 0, 1, 2, 3 bytes before it, START before a text."""
    wide = data.astype(np.uint32)
    runs = [wide]
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint32)
        before[back:] = wide[:-back]
        for k in range(back):
            heads = starts[:-1] + k
            before[heads[heads < starts[1:]]] = START
        runs.append(runs[-1] | (before << np.uint32(8 * back)))
    return runs


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def fit_languages(
    documents: DataFrame, learn: Column | None = None, bounds: Bounds | None = None, key: str = "doc_id"
) -> ContextModel:
    """Fit on the rows of `documents` that `learn` allows and whose `text` and `lang` are not null; on all, unless `bounds` are given.

    Texts are counted where they are; only the counts of different runs of four bytes reach the
    driver, which grow with the alphabets and not with the number of texts.
    """
    return _model(_all_sizes(_counted(_chosen(documents, learn, bounds, key), "lang").toArrow().to_pandas(), "lang"))


def fit_limits(
    documents: DataFrame, learn: Column | None = None, bounds: Bounds | None = None, key: str = "doc_id"
) -> tuple[ContextModel, dict[str, float]]:
    """The model of `fit_languages`, and for each language the bits a byte that its texts stay below by far.

    The learned texts, all unless `bounds` are given, are dealt into two halves by their hash, so
    that copies stay together, and each half is measured by a model of the other in the language of
    its label: `MARGIN` times what `USUAL` of them need at most, by steps of `STEP` bits. A
    language with texts in one half only has no limit.
    """
    half = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(2)).cast("int")
    texts = _chosen(documents, learn, bounds, key).withColumn("_half", half)
    texts = texts if bounds is None else settle(texts, "language-texts")
    counts = _all_sizes(_counted(texts, "_half", "lang").toArrow().to_pandas(), "_half", "lang")
    whole = _model(counts.groupby(["lang", "size", "run"], as_index=False)["n"].sum())
    halves = [_model(counts[counts["_half"] != h].drop(columns="_half")) for h in (0, 1)]
    del counts
    shared = documents.sparkSession.sparkContext.broadcast(halves)  # as large as there are different runs

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            held = np.array(batch.column("_half").to_pylist(), np.int64)
            rate = np.full(len(langs), np.nan)
            for h, model in enumerate(shared.value):
                of = {lang: i for i, lang in enumerate(model.languages)}
                mine = np.array([i for i in np.flatnonzero(held == h) if langs[i] in of and starts[i + 1] > starts[i]], np.int64)
                if len(mine):
                    bits = model.code_lengths(data, starts)[mine, [of[langs[i]] for i in mine]]
                    rate[mine] = bits / np.diff(starts)[mine]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rate, mask=np.isnan(rate))], names=["lang", "rate"])

    lettered = texts.where(F.col("text").rlike(r"\p{L}"))
    rates = lettered.select("lang", "_half", F.lower("text").alias("text")).mapInArrow(measure, "lang string, rate double")
    # Counts of rounded rates, so that a language's group holds some ten thousand numbers for any number of texts.
    steps = rates.where(F.col("rate").isNotNull()).groupBy("lang", (F.round(F.col("rate") / STEP) * STEP).alias("rate")).agg(F.count("*").alias("texts"))
    usual = steps.groupBy("lang").agg(F.percentile("rate", F.lit(USUAL), F.col("texts")).alias("rate"))
    return whole, {r["lang"]: MARGIN * r["rate"] for r in usual.collect()}


def keeps_limit(found: Column, text: Column, limits: dict[str, float]) -> Column:
    """Whether a text found to be in a language costs no more bits than that language's limit, and `SPARE` ones."""
    limit = F.lit(float("inf"))
    for lang, rate in limits.items():
        limit = F.when(found["lang_pred"] == lang, F.lit(rate)).otherwise(limit)
    size = F.greatest(F.octet_length(F.lower(text.cast("string"))), F.lit(1))
    return found["bits_per_byte"] <= limit + F.lit(float(SPARE)) / size


def _chosen(documents: DataFrame, learn: Column | None, bounds: Bounds | None, key: str) -> DataFrame:
    """`(lang, text)` of the rows to learn from: all that are allowed, or those that `bounds` choose by their key."""
    allowed = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = documents.where(allowed).select(F.col(key).alias("_key"), "lang", F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if bounds is None:
        return rows.select("lang", "text")
    # Chosen from narrow rows; the texts of the chosen ones are read afterwards. Of a frequent
    # language only the rows with the least hashes, four times as many as are wanted, are ranked.
    size = F.octet_length("text")
    narrow = rows.select("lang", "_key", F.xxhash64(F.lit(7), "_key").alias("_hash"), size.alias("_size"), (size <= bounds.text_bytes).alias("_short"))
    counted = narrow.where(F.col("_key").isNotNull()).groupBy("lang").agg(F.count_if("_short").alias("_shorts"))
    counted = settle(counted, "language-counts")
    texts = max(1, min(bounds.texts, bounds.all_texts // max(1, counted.count())))
    met = narrow.join(counted, "lang")
    share = F.lit(4.0 * texts) / F.greatest("_shorts", F.lit(1))
    early = (F.col("_hash").cast("double") + float(1 << 63)) / float(1 << 64) <= share
    by_hash = Window.partitionBy("lang").orderBy("_hash", "_key")
    short = met.where(F.col("_short") & early).withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= texts)
    by_size = Window.partitionBy("lang").orderBy("_size", "_hash", "_key")
    long = met.where(F.col("_shorts") == 0).withColumn("_rank", F.row_number().over(by_size)).where(F.col("_rank") <= min(texts, bounds.long_texts))
    chosen = short.select("lang", "_key", "_short").unionByName(long.select("lang", "_key", "_short")).distinct()
    # At most `all_texts` keys, or one or two a language.
    return rows.withColumn("_short", size <= bounds.text_bytes).join(F.broadcast(chosen), ["lang", "_key", "_short"], "left_semi").select("lang", "text")


def _counted(texts: DataFrame, *by: str) -> DataFrame:
    """How often each run of four bytes occurs in the texts of each language, or of each half and language."""
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by)
    return (
        texts.select(*by, F.lower("text").alias("text"))
        .mapInArrow(_count_runs, f"{schema}, run long, n long")
        .groupBy(*by, "run").agg(F.sum("n").alias("n"))
    )


def _all_sizes(counts, *by: str):
    """Counts of four-byte runs, and those of the shorter runs that they end in: each byte ends one run of each size."""
    counts["size"] = ORDER
    sizes = [counts]
    for size in range(ORDER - 1, -1, -1):
        shorter = sizes[-1].assign(run=sizes[-1]["run"] & ((1 << 8 * (size + 1)) - 1), size=size)
        sizes.append(shorter.groupby([*by, "size", "run"], as_index=False)["n"].sum())
    return pd.concat(sizes, ignore_index=True)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs are counted slice by slice; a task gives its counts away whenever it holds too many."""
    by, fields, groups = [], [], {}
    held, pending = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
    for batch in batches:
        by = [name for name in batch.schema.names if name != "text"]
        fields = [batch.schema.field(name).type for name in by]
        keys = zip(*(batch.column(name).to_pylist() for name in by))
        of = np.array([groups.setdefault(key, len(groups)) for key in keys], np.uint64)
        data, starts = text_bytes(batch.column("text"))
        for part, edges, texts, lead in _pieces(data, starts):
            runs = _runs(part, edges)[ORDER].astype(np.uint64)
            group = np.repeat(of[texts], np.diff(edges))
            pending.append(np.unique(((group << np.uint64(32)) | runs)[lead:], return_counts=True))
            if sum(len(values) for values, _ in pending) > HELD_RUNS:
                held, pending = _merged([held, *pending]), []
                if len(held[0]) > HELD_RUNS:
                    yield _run_rows(held, groups, by, fields)
                    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    held = _merged([held, *pending])
    if len(held[0]):
        yield _run_rows(held, groups, by, fields)


def _pieces(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice, int]]:
    """Slices of whole texts: bytes, where each text begins, which texts, and how many bytes are there for context only. A long text comes in pieces."""
    for a, b in slices(starts):
        if b - a > 1 or starts[b] - starts[a] <= 1 << 20:
            yield data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], slice(a, b), 0
            continue
        for at in range(int(starts[a]), int(starts[b]), 1 << 20):
            end = min(at + (1 << 20), int(starts[b]))
            lead = min(ORDER, at - int(starts[a]))
            yield data[at - lead:end], np.array([0, end - at + lead]), slice(a, b), lead


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, of = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, of, np.concatenate([n for _, n in parts]))
    return values, total


def _run_rows(held: tuple[np.ndarray, np.ndarray], groups: dict, by: list[str], fields: list) -> pa.RecordBatch:
    values, counts = held
    names = list(groups)
    of = pa.array((values >> np.uint64(32)).astype(np.int64))
    columns = [pa.array([name[i] for name in names], kind).take(of) for i, kind in enumerate(fields)]
    runs = (values & np.uint64((1 << 32) - 1)).astype(np.int64)
    return pa.RecordBatch.from_arrays([*columns, pa.array(runs), pa.array(counts)], names=[*by, "run", "n"])


def _model(counts) -> ContextModel:
    """Resolve all escapes once: every known run gets its cost in every language."""
    languages = sorted(counts["lang"].unique())
    width = max(len(languages), 1)
    codes, bits, escapes = [], [], []
    none = np.full(width, 8.0, np.float32)
    for order in range(ORDER + 1):
        rows = counts[counts["size"] == order]
        # The run of START alone precedes every text and so is a context, too.
        runs = np.union1d(rows["run"].to_numpy(np.uint32), np.uint32([START]))
        seen = np.zeros((len(runs), width))
        at = np.searchsorted(runs, rows["run"].to_numpy(np.uint32))
        seen[at, np.searchsorted(languages, rows["lang"].to_numpy(str))] = rows["n"].to_numpy()
        # A context's total and number of different next bytes, per language (method C).
        parent = runs >> np.uint32(8) if order else np.zeros(len(runs), np.uint32)
        contexts, of = np.unique(parent, return_inverse=True)
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(seen / (total + kinds)[of])
        if order == 0:
            below = none[None, :]
            none = (none + leave[0]).astype(np.float32)
        else:
            # A run's last bytes form a run one shorter, which was seen wherever the run was.
            shorter, known = _find(codes[order - 1], runs & np.uint32((1 << 8 * order) - 1))
            below = bits[order - 1][shorter]
            out = np.zeros((len(codes[order - 1]), width), np.float32)
            place, known = _find(codes[order - 1], contexts)
            out[place[known]] = leave[known]
            escapes.append(out)
        resolved = np.where(seen > 0, own, leave[of] + below)
        codes.append(runs)
        bits.append(resolved.astype(np.float32))
    return ContextModel(languages, codes, bits, escapes, none)


def language_of(spark: SparkSession, model: ContextModel) -> Callable[[Column], Column]:
    """An expression for a text's `(lang_pred, score, bits_per_byte)`.

    `lang_pred` is the language with the least code length for the whole lower-cased text (ties:
    the first by name) and `score` its share of the probability, all languages being alike
    beforehand. Null, empty and letterless texts, and every text if nothing was learned, are
    `und` with score 0 and null bits.
    """
    shared = spark.sparkContext.broadcast(model)  # as large as there are different runs

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def identify(texts: pa.Array, letters: pa.Array) -> pa.Array:
        fitted = shared.value
        data, starts = text_bytes(texts)
        valid = letters.to_numpy(zero_copy_only=False).astype(bool) & bool(fitted.languages)
        lengths = fitted.code_lengths(data, starts) if fitted.languages else np.zeros((len(valid), 1))
        least = lengths.min(axis=1)
        share = 1.0 / np.exp2(np.maximum(least[:, None] - lengths, -1000.0)).sum(axis=1)
        names = np.array(fitted.languages or ["und"], dtype=object)[lengths.argmin(axis=1)]
        size = np.maximum(np.diff(starts), 1)
        return pa.StructArray.from_arrays(
            [pa.array(np.where(valid, names, "und"), pa.string()), pa.array(np.where(valid, share, 0.0)),
             pa.array(least / size, mask=~valid)],
            names=["lang_pred", "score", "bits_per_byte"],
        )

    def expression(text: Column) -> Column:
        text = text.cast("string")
        return identify(F.coalesce(F.lower(text), F.lit("")), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))

    return expression


def identify_languages(documents: DataFrame, model: ContextModel, key: str = "doc_id") -> DataFrame:
    """`(key, lang_pred, score, bits_per_byte)` per row of `documents`, from `text` alone.

    Rows are independent: no shuffle, repeated rows stay, further columns are ignored.
    """
    found = language_of(documents.sparkSession, model)(F.col("text"))
    return documents.select(F.col(key), found.alias("_found")).select(key, "_found.*")
