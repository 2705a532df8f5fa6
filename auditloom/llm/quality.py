"""Per-document text statistics and how far a document lies from prose.

One Arrow pass computes the statistics of each document and of its passages, runs of lines of some 200
characters between blank lines. Mean and covariance of prose are estimated per language from the
passages of all documents, trimmed towards the bulk in a few rounds. A passage's outlierness is its
Mahalanobis distance; a document's is the median over its passages, weighted by their characters. A
document whose distance is beyond the cut has more than half of its text outside of prose, and that
alone decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import map_arrow, materialise

#: Statistics in the order of the vectors; the words of a line enter as a logarithm.
STATS = ["log_line_words", "mean_word_length", "symbol_ratio", "line_punct_share", "common_word_share", "joining_word_share", "digit_ratio", "distinct_share"]
#: Passages that start the estimate: their least words a line and share of joining words.
SEED_WORDS, SEED_JOINING = 5, 0.15
#: Trimming rounds, and the squared distance (0.999 quantile of chi-square with 8 degrees) beyond which a passage is no inlier.
ROUNDS, CUT = 4, 26.1
#: Squared distance beyond which a document is no prose.
FAR = 26.1
#: Spread added to each statistic, so that one that never varies among prose keeps a finite scale.
FLOOR = {"log_line_words": 0.3, "mean_word_length": 0.3, "symbol_ratio": 0.015, "line_punct_share": 0.25, "common_word_share": 0.04, "joining_word_share": 0.03, "digit_ratio": 0.02, "distinct_share": 0.08}
#: Characters from which a passage is closed, and from which a line is cut at the ends of its sentences.
PASSAGE = 200

# Common words of each language. The first group are articles and the like, which
# lists of nouns hold too; the second joins words to sentences.
_ARTICLES = {
    "en": "the a an of",
    "de": "der die das den dem des ein eine einen einem einer eines",
    "fr": "le la les un une des du de d l",
    "es": "el la los las un una unos unas de del",
}
_GLUE = {
    "en": "and or but that which who whom whose what when where why how if because although while until unless since than then as so yet not no nor never only also just still even both either neither each every any some few many most more less such "
    "is are was were be been being am has have had do does did will would shall should can could may might must to in on at by for from with without within into onto over under about after before between during against through across behind beside near out up down off "
    "it its he she they them their his her we us our you your i my me this these those there here others other another one once",
    "de": "und oder aber denn dass daß wenn weil als wie ob obwohl während bis seit nachdem bevor damit sondern nicht kein keine keinen nie nur auch noch schon sehr mehr so ist sind war waren sein hat haben hatte wird werden wurde kann können soll muss gab gibt "
    "im in am an auf aus bei mit nach von vom vor zu zum zur für über unter um durch gegen ohne zwischen trotz wegen es er sie wir ihr ich man sich mich uns dieser diese dieses jeder jede jedes heute vielleicht dort hier was wer wo besser",
    "fr": "et ou mais donc car que qui quoi dont où quand comme si parce lorsque puisque ne n pas plus jamais rien personne aussi encore déjà très est sont était être a ont avait avoir fait faut fallu vaut peut doit sera "
    "dans en à au aux sur sous par pour avec sans chez entre vers selon malgré pendant depuis avant après contre ce c cet cette ces il elle ils elles on nous vous je se s son sa ses leur leurs mon notre tout tous dit voir cas y",
    "es": "y e o u pero sino porque que quien cuando donde como si aunque mientras ni no nunca nada nadie también ya muy más menos es son era ser está están fue ha han había hay tiene puede debe será hace conviene sabía dice "
    "en a al ante bajo con contra desde durante entre hacia hasta para por según sin sobre tras este esta estos estas ese esa eso esto él ella ellos lo le les se su sus nos me mi cada todo todos otro otra antes después pesar",
}
LANGUAGES = list(_ARTICLES)
COMMON = {k: frozenset((_ARTICLES[k] + " " + _GLUE[k]).split()) for k in LANGUAGES}
_OF: dict[str, list[int]] = {}
for _i, _k in enumerate(LANGUAGES):
    for _w in COMMON[_k]:
        _OF.setdefault(_w, []).append(_i)

_GLUE_OF = {k: frozenset(_GLUE[k].split()) for k in LANGUAGES}
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?…;])[\"'”’»)]*\s+(?=\S)")
_QUOTE = re.compile(r"^(?:[>|]\s?)+")


def _lines(text: str) -> list[str]:
    """Trimmed lines, ``""`` where a passage must end; marks of quotation are no text."""
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if s[:1] == ">":
            s = _QUOTE.sub("", s).strip()
        if len(s) <= 2 * PASSAGE:
            out.append(s)
            continue
        out.append("")
        at = size = 0
        for m in _SENTENCE.finditer(s):
            if m.end() - at >= PASSAGE:
                out += [s[at : m.end()].strip(), ""]
                at = m.end()
        out += [s[at:].strip(), ""]
    return out


def describe(text: str | None) -> tuple:
    """``(lang, words, stats of the document, [(characters, stats)] of its passages)``.

    The language is the one whose common words are most frequent, ``""`` if none occurs. Null, empty and
    blank texts have no words, no passages, and all statistics 0.
    """
    if text is None or not text.strip():
        return "", 0, [0.0] * len(STATS), []
    lines = [(s, _WORD.findall(s.lower())) for s in _lines(text)]
    hits = [0] * len(LANGUAGES)
    for _, ws in lines:
        for w in ws:
            of = _OF.get(w)
            if of:
                for i in of:
                    hits[i] += 1
    best = max(hits)
    lang = LANGUAGES[hits.index(best)] if best else ""
    common, glue = (COMMON[lang], _GLUE_OF[lang]) if lang else (frozenset(), frozenset())
    passages: list[list] = []
    now: list | None = None  # lines, lines ending in punctuation, characters, words, letters in words, digits, common, joining
    every: list[str] = []
    seen: list[str] = []

    def close():
        nonlocal now
        if now is not None:
            now.append(len(set(seen)))
            passages.append(now)
            seen.clear()
            now = None

    for s, ws in lines:
        if not s:
            close()
            continue
        if now is None:
            now = [0] * 8
        now[0] += 1
        now[1] += _END.search(s) is not None
        now[2] += len(s) - s.count(" ") - s.count("\t")
        now[3] += len(ws)
        now[4] += sum(map(len, ws))
        for w in ws:
            if w in common:
                now[6] += 1
                now[7] += w in glue
            elif w.isdigit():
                now[5] += len(w)
        seen += ws
        every += ws
        if now[2] >= PASSAGE:
            close()
    close()
    total = [sum(p[i] for p in passages) for i in range(8)] + [len(set(every))]
    return lang, total[3], _stats(total), [(p[2], _stats(p)) for p in passages]


def _stats(p: list) -> list[float]:
    lines, ended, chars, n, letters, digits, common, glue, distinct = p
    return [
        math.log1p(n / lines) if lines else 0.0, letters / n if n else 0.0, max(0.0, (chars - letters) / chars) if chars else 0.0, ended / lines if lines else 0.0,
        common / n if n else 0.0, glue / n if n else 0.0, digits / chars if chars else 0.0, distinct / n if n else 0.0,
    ]


_STATISTICS = "doc_id long, lang string, n_words long, " + ", ".join(f"{s} double" for s in STATS)
_DESCRIBED = _STATISTICS + ", sizes array<int>, passages array<float>"


def _each(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids, langs, words, stats, sizes, flat = [], [], [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lang, n, own, passages = describe(t)
            ids.append(i)
            langs.append(lang)
            words.append(n)
            stats.append(own)
            sizes.append([c for c, _ in passages])
            flat.append(np.array([v for _, p in passages for v in p], dtype=np.float32))
        table = np.array(stats, dtype=float).reshape(len(ids), len(STATS))
        cols = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.int64()), *(pa.array(table[:, k].copy()) for k in range(len(STATS)))]
        cols += [pa.array(sizes, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "n_words", *STATS, "sizes", "passages"])


def _described(documents: DataFrame) -> DataFrame:
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _each, _DESCRIBED)


def text_statistics(documents: DataFrame) -> DataFrame:
    """The statistics of each document's whole text; rows in, rows out, without a shuffle.

    ``mean_line_words`` is the number of words a line.
    """
    return _described(documents).select("doc_id", "lang", "n_words", F.expm1("log_line_words").alias("mean_line_words"), *STATS[1:])


def _vectors(b):
    """``(passages' statistics, language of each, document of each, characters of each)`` of a batch."""
    import numpy as np

    sizes = b.column("sizes").to_pylist()
    count = [len(s) for s in sizes]
    x = np.asarray(b.column("passages").flatten(), dtype=float).reshape(-1, len(STATS))
    of = np.repeat(np.arange(len(count)), count)
    langs = np.array(b.column("lang").to_pylist(), dtype=object)
    return x, langs[of] if len(of) else langs[:0], of, np.array([c for s in sizes for c in s], dtype=float)


def _distances(x, langs, ready: dict):
    """Squared distance of each passage and each statistic's part of it."""
    import numpy as np

    part = np.zeros_like(x)
    for k in set(langs.tolist()):
        mean, inv = ready.get(k) or ready["*"]
        at = langs == k
        z = x[at] - mean
        part[at] = z * (z @ inv)  # sums to the squared distance
    return part.sum(axis=1), part


def _ready(model: dict) -> dict:
    import numpy as np

    return {k: (np.array(m), np.array(p)) for k, (m, p) in model.items()}


def _sums(model: dict | None):
    """Per partition and language: number, sums and products of the passages that count as prose so far."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ready = _ready(model) if model else None
        acc: dict[str, object] = {}
        for b in batches:
            x, langs, _, _ = _vectors(b)
            if not len(x):
                continue
            ok = (x[:, STATS.index("joining_word_share")] >= SEED_JOINING) & (x[:, 0] >= math.log1p(SEED_WORDS)) & (langs != "") if ready is None else langs != ""
            if ready is not None:
                ok &= _distances(x, langs, ready)[0] <= CUT
            for k in set(langs[ok].tolist()):
                one = np.concatenate([np.ones((int((ok & (langs == k)).sum()), 1)), x[ok & (langs == k)]], axis=1)
                acc[k] = acc.get(k, 0.0) + one.T @ one
        rows = [(k, i, float(v)) for k, m in acc.items() for i, v in enumerate(m.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], names=["lang", "k", "v"])

    return run


def _moments(rows: DataFrame, model: dict | None) -> dict:
    """Number, mean and covariance by language: a few dozen sums a language, combined before their shuffle."""
    import numpy as np

    d = len(STATS) + 1
    out: dict[str, object] = {}
    for r in map_arrow(rows, _sums(model), "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["lang"], np.zeros(d * d))[r["k"]] = r["v"]
    return {k: m.reshape(d, d) for k, m in out.items()}


def _model(found: dict) -> dict:
    """Mean and inverse covariance by language, ``*`` for texts of no known one or of one with little prose."""
    import numpy as np

    def one(m):
        n = m[0, 0]
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        return mean.tolist(), np.linalg.inv(cov + np.diag([FLOOR[s] ** 2 for s in STATS])).tolist()

    default = [math.log1p(12), 5.0, 0.04, 0.6, 0.45, 0.3, 0.01, 0.85], np.diag([1 / FLOOR[s] ** 2 for s in STATS]).tolist()
    out = {"*": one(sum(found.values())) if found else default}
    for lang, m in found.items():
        if m[0, 0] >= 10 * len(STATS):
            out[lang] = one(m)
    return out


def _scored(model: dict):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ready = _ready(model)
        for b in batches:
            x, langs, of, size = _vectors(b)
            d2, part = _distances(x, langs, ready) if len(x) else (np.zeros(0), np.zeros((0, len(STATS))))
            got, parts = np.full(b.num_rows, np.inf), np.zeros((b.num_rows, len(STATS)))
            order = np.lexsort((d2, of))
            first = np.searchsorted(of[order], np.arange(b.num_rows + 1))
            for k in range(b.num_rows):  # the passage that holds the middle character
                mine = order[first[k] : first[k + 1]]
                if len(mine) and size[mine].sum() > 0:
                    run_ = np.cumsum(size[mine])
                    mid = mine[np.searchsorted(run_, run_[-1] / 2)]
                    got[k], parts[k] = d2[mid], part[mid]
            cols = [b.column(n) for n in ["doc_id", "lang", "n_words", *STATS]] + [pa.array(got)] + [pa.array(parts[:, i].copy()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "n_words", *STATS, "distance2", *[f"by_{s}" for s in STATS]])

    return run


def outlierness(documents: DataFrame) -> DataFrame:
    """Statistics, ``distance`` from prose of the same language, its square, and ``by_*``, each statistic's part of the square.

    The first estimate takes the passages with many joining words, later ones the inliers of the estimate
    before. Languages with few such passages, and texts without any common word, use all languages'
    estimate; without any prose at all a plain default holds. Empty and blank texts are infinitely far and
    have no parts. Repeated rows count as often as they occur; an empty table gives an empty result.
    """
    base = materialise(_described(documents))
    rows = base.select("lang", "sizes", "passages")
    model = None
    for _ in range(ROUNDS):
        model = _model(_moments(rows, model))
    schema = _STATISTICS + ", distance2 double, " + ", ".join(f"by_{s} double" for s in STATS)
    return map_arrow(base, _scored(model), schema).withColumn("distance", F.sqrt(F.greatest("distance2", F.lit(0.0))))


def not_prose(documents: DataFrame) -> DataFrame:
    """``(doc_id, distance)`` of documents that are no natural prose: those whose distance is beyond the cut.

    Null, empty and blank texts belong to them.
    """
    return outlierness(documents).where(F.col("distance2") > FAR).select("doc_id", "distance")
