"""Language identification: known words first, then ever shorter character n-grams.

A model has, for each language, log relative frequencies of words and of the character n-grams of words (with
marks at both ends).  A word that any language knows is scored by its word frequencies; an unseen word is cut
into its n-grams of the greatest length of which the model knows one, the mean of whose scores counts for the
word; a word without any known n-gram says nothing.  Documents take the language of the greatest sum; the score
is that language's share after a softmax of the sums, tempered so that long texts do not all score 1.

Words are runs of letters and marks (Unicode categories L and M) that begin with a letter, so numerals and signs are
none, and scripts that write vowels as marks keep their words whole.

fit() learns from a bounded sample of labelled rows, ROWS and BYTES in expectation, dealt evenly to the languages and
chosen by hash.  The model has every word and n-gram of the sample, as sparse rows of what the languages that know it
score above those that do not; so its size is bounded by the sample's, whatever the number of languages.

Defined cases: texts that are null or have no letter get `und` with score 0; letters of no known n-gram leave the
languages level, and the first in alphabetical order is given; rows without text or label teach nothing; without
any labelled row every text is `und`; repeated rows stay repeated; ties go to the first language in order; a very long
text is one row's work, its words counted once; where docs has columns of the new ones' names, underscores are put
behind the latter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, slices

UNDETERMINED = "und"
LONGEST = 5
#: Bounds of the fit: labelled rows, and bytes of their texts, in expectation.
ROWS, BYTES = 6000, 6 << 20
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Added to every count.
SMOOTH = 0.5
#: Unseen words whose n-grams a worker keeps.
CACHE = 50_000


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))] if len(marked) >= n else []


@dataclass
class Model:
    """words and grams give rows of sparse scores: languages langs_of[cuts[i]:cuts[i + 1]] score values[...] above floors[kind]."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    floors: np.ndarray
    cuts: np.ndarray
    langs_of: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.cache: dict[str, tuple[int, list[int]]] = {}

    @classmethod
    def of(cls, langs: list[str], kinds: np.ndarray, names: list[str], lang: np.ndarray, n: np.ndarray) -> Model:
        """From rows (kind: 0 for words, else the length of n-grams; name; language; count)."""
        totals = np.zeros((LONGEST + 1, len(langs)))
        np.add.at(totals, (kinds, lang), n)
        words: dict[str, int] = {}
        parts: dict[str, int] = {}
        for kind, name in zip(kinds.tolist(), names):
            found = parts if kind else words
            if name not in found:
                found[name] = len(found)
        parts = {k: len(words) + v for k, v in parts.items()}
        at = np.fromiter((parts[x] if k else words[x] for k, x in zip(kinds.tolist(), names)), np.int64, len(names))
        size = np.where(np.arange(LONGEST + 1) > 0, len(parts), len(words))
        below = totals + SMOOTH * size[:, None]
        order = np.lexsort((lang, at))
        value = np.log(n + SMOOTH) - np.log(SMOOTH)
        cuts = np.r_[0, np.cumsum(np.bincount(at, minlength=len(words) + len(parts)))]
        return cls(langs, words, parts, np.log(SMOOTH) - np.log(below), cuts, lang[order].astype(np.int32), value[order])

    def unseen(self, word: str) -> tuple[int, list[int]]:
        """The greatest length of which an n-gram is known, and the rows of these; 0 and none."""
        for n in range(LONGEST, 0, -1):
            found = [v for g in grams(word, n) if (v := self.grams.get(g)) is not None]
            if found:
                return n, found
        return 0, []

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(tokens(text))
        if not counts or not self.langs:
            return UNDETERMINED, 0.0
        if len(self.cache) + len(counts) > CACHE:
            self.cache.clear()
        words, cache, at, weight, floor = self.words, self.cache, [], [], [0.0] * (LONGEST + 1)
        for word, n in counts.items():
            i = words.get(word)
            if i is not None:
                at.append(i)
                weight.append(n)
                floor[0] += n
                continue
            if (found := cache.get(word)) is None:
                found = cache[word] = self.unseen(word)
            kind, rows = found
            if rows:
                at += rows
                weight += [n / len(rows)] * len(rows)
                floor[kind] += n
        rows = np.array(at, np.int64)
        begin = self.cuts[rows]
        many = self.cuts[rows + 1] - begin
        place = np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum())) if len(rows) else rows
        sums = np.bincount(self.langs_of[place], self.values[place] * np.repeat(np.array(weight, np.float64), many), len(self.langs)) + floor @ self.floors
        sums *= min(1.0, 12 / sum(counts.values()))
        shares = np.exp(sums - sums.max())
        best = int(np.argmax(sums))
        return self.langs[best], float(shares[best] / shares.sum())


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, rows: int = ROWS, most_bytes: int = BYTES) -> Model:
    """Learn from labelled rows: about `rows` and `most_bytes` of them at most, as many of each language if it has them."""
    labelled = docs.where((train if train is not None else F.lit(True)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 30)) / float(1 << 30)).alias("unit"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    kinds, every, size = counts.agg(F.count("*"), F.sum("n"), F.sum("size")).first()
    if not kinds:
        empty = np.zeros(0, np.int64)
        return Model([], {}, {}, np.zeros((LONGEST + 1, 0)), np.zeros(1, np.int64), empty, np.zeros(0))
    if kinds <= rows:  # a row for each language
        rate = F.least(F.lit(rows / kinds) / F.col("n"), F.lit(most_bytes / kinds) / F.col("size"))
        sample = labelled.join(F.broadcast(counts.select("lang", rate.alias("rate"))), "lang").where("unit < rate or rate is null")
    else:
        sample = labelled.where(F.col("unit") < min(1.0, rows / every, most_bytes / max(size, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):  # counts of a slice at a time; Spark sums them
            seen: defaultdict[str, Counter] = defaultdict(Counter)
            for language, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen[language].update(tokens(body))
            for language, counter in seen.items():
                yield part(language, 0, counter)
                for size in range(1, LONGEST + 1):
                    found: Counter = Counter()
                    for word, n in counter.items():
                        for g in grams(word, size):
                            found[g] += n
                    yield part(language, size, found)

    def part(language: str, kind: int, counts: Counter) -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array([language] * n, pa.string()), pa.array([kind] * n, pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

    summed = sample.select("lang", "text").mapInArrow(run, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # bounded by the sample
    order = pc.sort_indices(got, [("kind", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
    got = got.take(order)
    langs = sorted(pc.unique(got.column("lang")).to_pylist())
    at = {k: i for i, k in enumerate(langs)}
    lang_rows = np.array([at[x] for x in got.column("lang").to_pylist()], np.int64)
    return Model.of(langs, got.column("kind").to_numpy().astype(np.int64), got.column("gram").to_pylist(), lang_rows, got.column("n").to_numpy().astype(np.float64))


def identify(docs: DataFrame, model: Model, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; no column but the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    prediction, score = fresh(docs, prediction, score)
    (body,) = fresh(docs.withColumns({prediction: F.lit(""), score: F.lit(0.0)}), "body")
    source = docs.withColumn(body, F.col(text))
    schema = docs.withColumn(prediction, F.lit("")).withColumn(score, F.lit(0.0)).schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, body, 2 << 20):
            found = [model.predict(x) for x in batch.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names
            )

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of docs whose text has a language, told with at least that score."""
    prediction, score = fresh(docs, "lang_pred", "lang_score")
    found = identify(docs, model, text, prediction, score)
    return found.where((F.col(prediction) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)


def oracle(modulus: int = 4, rest: int = 2) -> str:
    """DuckDB SQL of the query where the sample is all labelled training rows, which the bounds of fit() decide."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '\\p{L}[\\p{L}\\p{M}]*')"
    cut = lambda source, keep: f"SELECT {keep}, k, substr(m, i, k) AS g FROM (SELECT {keep}, k, m, unnest(range(1, length(m) - k + 2)) AS i FROM (SELECT {keep}, k, CASE WHEN k > 1 THEN '^' || w || '$' ELSE w END AS m FROM {source}, (SELECT unnest(range(1, {LONGEST + 1})) AS k)) WHERE length(m) >= k)"
    score = lambda n, total, size: f"ln((coalesce({n}, 0) + {SMOOTH}::DOUBLE) / (coalesce({total}, 0) + {SMOOTH}::DOUBLE * {size}))"
    return f"""
WITH RECURSIVE t(i, k, v) AS (SELECT CAST(unnest(range(256)) AS BIGINT), 0, CAST(unnest(range(256)) AS BIGINT)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS v FROM t WHERE k = 8),
b AS (SELECT row_number() OVER () AS rid, *, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
d AS MATERIALIZED (SELECT rid, doc_id, lang, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: xor(a >> 8, tab.v[(xor(a, b) & 255) + 1])), 4294967295) % {modulus} = {rest} AS held_out FROM b, tab),
w AS MATERIALIZED (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest({words}) AS w FROM d) GROUP BY rid, w),
tw AS MATERIALIZED (SELECT lang, w, CAST(sum(n) AS BIGINT) AS n FROM w JOIN d USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, w),
tg AS MATERIALIZED (SELECT lang, k, g, CAST(sum(n) AS BIGINT) AS n FROM ({cut("tw", "lang, n")}) GROUP BY ALL),
l AS (SELECT DISTINCT lang FROM tw),
v AS MATERIALIZED (SELECT DISTINCT w FROM tw),
wt AS (SELECT lang, sum(n) AS total FROM tw GROUP BY lang), gt AS (SELECT lang, k, sum(n) AS total FROM tg GROUP BY lang, k),
size AS (SELECT (SELECT count(*) FROM v) AS words, (SELECT count(*) FROM (SELECT DISTINCT g FROM tg)) AS parts),
sw AS MATERIALIZED (SELECT v.w, l.lang, {score("tw.n", "wt.total", "size.words")} AS s FROM v CROSS JOIN l CROSS JOIN size LEFT JOIN tw ON tw.w = v.w AND tw.lang = l.lang LEFT JOIN wt ON wt.lang = l.lang),
sg AS MATERIALIZED (SELECT p.k, p.g, l.lang, {score("tg.n", "gt.total", "size.parts")} AS s FROM (SELECT DISTINCT k, g FROM tg) p CROSS JOIN l CROSS JOIN size LEFT JOIN tg ON tg.g = p.g AND tg.k = p.k AND tg.lang = l.lang LEFT JOIN gt ON gt.lang = l.lang AND gt.k = p.k),
u AS (SELECT DISTINCT w FROM w WHERE w NOT IN (SELECT w FROM v)),
ug AS (SELECT x.w, x.k, x.g FROM ({cut("u", "w")}) x WHERE EXISTS (SELECT 1 FROM tg WHERE tg.g = x.g AND tg.k = x.k)),
su AS (SELECT w, lang, avg(s) AS s FROM (SELECT w, k, g FROM ug QUALIFY k = max(k) OVER (PARTITION BY w)) JOIN sg USING (k, g) GROUP BY w, lang),
e AS (SELECT rid, lang, sum(n * s) AS s FROM w JOIN (SELECT * FROM sw UNION ALL SELECT * FROM su) USING (w) GROUP BY rid, lang),
c AS (SELECT rid, least(1, 12 / sum(n)) AS heat FROM w GROUP BY rid),
a AS (SELECT rid, lang, coalesce(s, 0) AS s, heat FROM c CROSS JOIN l LEFT JOIN e USING (rid, lang)),
p AS (SELECT rid, arg_min(lang, {{'s': -s, 'l': lang}}) AS lang_pred, 1 / sum(exp((s - best) * heat)) AS score FROM (SELECT *, max(s) OVER (PARTITION BY rid) AS best FROM a) GROUP BY rid)
SELECT doc_id, held_out, coalesce(lang_pred, '{UNDETERMINED}') AS lang_pred, round(coalesce(score, 0.0), 6) AS score FROM d LEFT JOIN p USING (rid)
"""
