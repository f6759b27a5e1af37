"""Language of a text by hierarchical discrimination: its family first, then one-versus-one machines inside the family.

All models are linear support vector machines over hashed runs of one to four bytes of the lower-case text, with all that is
no letter as one space. A family's machine tells it from all others; two languages of one family have a machine that is
fitted on texts of these two alone, so its weights go to what little tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquill.functions.tables import materialize
from barquill.llm.names import others, unused
from barquill.llm.words import bytes_of

#: ISO 639-1 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it la oc pt ro",
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id ms jv su tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}

#: Bits of a hashed feature, bytes of the longest run, and labelled texts that models are fitted on at most.
BITS, LONGEST, SAMPLE = 16, 4, 6000
#: Rounds over the texts, and the bound of a text's share in a machine.
ROUNDS, BOUND = 12, 10.0

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    """The family of a code (``pt``, ``pt-BR``), or the code itself."""
    code = lang.replace("_", "-").split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


def runs(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts ``lo`` to ``hi`` (about ``size`` bytes), the features of all runs of bytes in them, and the text of each."""
    data, at = bytes_of(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        plain = _PLAIN[data[at[lo] : at[hi]]]
        text = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(at[lo : hi + 1]))
        solid = plain != 0x20
        solid[1:] |= (plain[:-1] != 0x20) | (text[1:] != text[:-1])  # of several spaces the first, and one where a text begins
        solid[:1] = True
        plain, text = plain[solid].astype(np.uint32), text[solid]
        features, owners = [], []
        run = np.zeros(len(plain), np.uint32)
        for k in range(min(LONGEST, len(plain))):
            run = (run[: len(plain) - k] << np.uint32(8)) | plain[k:]
            inside = text[: len(plain) - k] == text[k:]
            features.append((((run[inside] + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
            owners.append(text[: len(plain) - k][inside])
        yield lo, hi, np.concatenate(features or [np.zeros(0, np.int32)]), np.concatenate(owners or [np.zeros(0, np.int32)])
        lo = hi


def shares(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its features, each once, with their share of all; and the n + 1 bounds of texts."""
    features, values, counts = [], [], []
    for lo, hi, feature, text in runs(column):
        key, n = np.unique((text.astype(np.int64) << BITS) | feature, return_counts=True)
        owner = key >> BITS
        features.append((key & ((1 << BITS) - 1)).astype(np.int32))
        values.append((n / np.bincount(text, minlength=hi - lo)[owner]).astype(np.float32))
        counts.append(np.bincount(owner, minlength=hi - lo))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return np.concatenate(features or [np.zeros(0, np.int32)]), np.concatenate(values or [np.zeros(0, np.float32)]), bounds


@dataclass
class Machine:
    """Weights by feature, an offset, and the slope and place of the sigmoid that makes margins probabilities."""

    weights: np.ndarray
    offset: float
    slope: float
    place: float

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (mean + self.offset) + self.place, -60, 60)))


def _solve(texts: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float]:
    """A machine by coordinate ascent in the dual (hinge loss): one text's share at a time, others held.

    Shares of the rarer side may be larger, so that both sides weigh the same.
    """
    weights, offset = np.zeros(1 << BITS), 0.0
    share, norm = np.zeros(len(sign)), np.array([float(v @ v) + 1.0 for _, v in texts])
    sides = {s: max(1, int((sign == s).sum())) for s in (-1, 1)}
    most = np.array([BOUND * len(sign) / (2 * sides[s]) for s in sign.tolist()])
    rng = np.random.default_rng(11)
    for _ in range(ROUNDS):
        for i in rng.permutation(len(sign)).tolist():
            feature, value = texts[i]
            slope = sign[i] * (float(weights[feature] @ value) + offset) - 1.0
            now = min(max(share[i] - slope / norm[i], 0.0), most[i])
            if now != share[i]:
                step = (now - share[i]) * sign[i]
                weights[feature] += step * value
                offset += step
                share[i] = now
    return weights, offset


def _sigmoid(margin: np.ndarray, sign: np.ndarray) -> tuple[float, float]:
    """Slope and place of the sigmoid that suits the margins of texts not fitted on, by Newton's steps, slightly shrunk."""
    ups = int((sign > 0).sum())
    goal = np.where(sign > 0, (ups + 1) / (ups + 2), 1 / (len(sign) - ups + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (p - goal) + 1e-3 * at
        at = at - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    return (float(max(at[0], 1e-3)), float(at[1])) if np.isfinite(at).all() else (1.0, 0.0)


def fit(feature: np.ndarray, value: np.ndarray, bounds: np.ndarray, sign: np.ndarray) -> Machine:
    """Fit on texts given by features and shares, of the side +1 or -1. Features are scaled by how common they are.

    Margins for the sigmoid come from two machines, each fitted on half of the texts and held against the other half.
    """
    scale = 1.0 / np.sqrt(np.bincount(feature, value, 1 << BITS) / len(sign) + 1e-5)
    texts = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        texts.append((feature[lo:hi], value[lo:hi] * scale[feature[lo:hi]]))
    half, margin = np.arange(len(sign)) % 2, np.zeros(len(sign))
    for h in (0, 1):
        weights, offset = _solve([t for t, x in zip(texts, half, strict=True) if x == h], sign[half == h])
        for i in np.flatnonzero(half != h).tolist():
            margin[i] = float(weights[texts[i][0]] @ texts[i][1]) + offset
    slope, place = _sigmoid(margin, sign)
    weights, offset = _solve(texts, sign)
    return Machine((weights * scale).astype(np.float32), offset, slope, place)


@dataclass
class Model:
    """Languages by family, a machine for each family, and one for each two languages of a family (yes: the first)."""

    families: dict[str, list[str]]
    of_family: dict[str, Machine]
    of_pair: dict[tuple[str, str], Machine]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and the probability of its family times that of the language in the family."""
        langs: list[str] = []
        scores: list[np.ndarray] = []
        names = sorted(self.families)
        for lo, hi, feature, text in runs(column):
            n = hi - lo
            total = np.maximum(np.bincount(text, minlength=n), 1)
            chance = np.ones((len(names), n))
            if len(names) > 1:
                for i, name in enumerate(names):
                    machine = self.of_family[name]
                    chance[i] = machine.probability(np.bincount(text, machine.weights[feature], n) / total)
            family, top = chance.argmax(axis=0), chance.max(axis=0) / np.maximum(chance.sum(axis=0), 1e-300)
            lang = np.empty(n, object)
            for i in np.unique(family).tolist():
                inside = family == i
                members = self.families[names[i]]
                some = inside[text]
                votes, sure = np.zeros((len(members), n)), np.zeros((len(members), n))
                for a, x in enumerate(members):
                    for b in range(a + 1, len(members)):
                        machine = self.of_pair[x, members[b]]
                        p = machine.probability(np.bincount(text[some], machine.weights[feature[some]], n) / total)
                        votes[a] += p >= 0.5
                        votes[b] += p < 0.5
                        sure[a] += p
                        sure[b] += 1.0 - p
                rivals = max(1, len(members) - 1)
                best = (votes + sure / (rivals + 1)).argmax(axis=0)  # ties in votes go to what is surer
                lang[inside] = np.array(members, object)[best[inside]]
                if len(members) > 1:
                    top[inside] *= sure[best[inside], np.flatnonzero(inside)] / rivals
            langs += lang.tolist()
            scores.append(top)
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def _fit_group(table: pa.Table) -> pa.Table:
    """One machine from the rows (family or first, second, sign, order, feature, share) that it is fitted on."""
    table = table.combine_chunks().sort_by([("place", "ascending"), ("lang", "ascending")])
    column = table.column("feature").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    value = table.column("share").combine_chunks().flatten().to_numpy()
    sign = np.where(table.column("yes").combine_chunks().to_numpy(zero_copy_only=False), 1, -1)
    machine = fit(column.flatten().to_numpy(), value, bounds, sign)
    used = np.flatnonzero(machine.weights).astype(np.int32)
    return pa.table({
        "first": table.column("first").combine_chunks().slice(0, 1), "second": table.column("second").combine_chunks().slice(0, 1), "feature": [used],
        "weight": [machine.weights[used]], "rest": [[machine.offset, machine.slope, machine.place]],
    })


def _letters() -> Column:
    return F.col("text").rlike(r"\p{L}")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` rows of ``docs`` (text, lang): of each language the same number, if it has as many.

    Rows without text, letters or lang teach nothing. A language's rows are those of different texts with the smallest
    hashes, chosen by a bound that follows from its count, so a language of any size is not ordered. Features are made
    where the texts are; each machine is fitted in a task of its own, on rows of the sample, whose size is bounded.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({}, {}, {})
    each = max(1, sample // len(counts))
    spread = 1 << 40
    rates = docs.sparkSession.createDataFrame([(lang, spread * min(1.0, each / n)) for lang, n in counts.items()], "lang string, below double")
    picked = usable.join(F.broadcast(rates), "lang").withColumn("place", F.xxhash64("text")).where(F.pmod("place", F.lit(spread)) < F.col("below")).where(_letters())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                feature, value, bounds = shares(part.column(2))
                at = pa.array(bounds.astype(np.int32))
                made = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (feature, value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["lang", "place", "feature", "share"])

    rows = picked.select("lang", "place", "text").mapInArrow(extract, "lang string, place long, feature array<int>, share array<float>")
    rows = materialize(rows.dropDuplicates(["lang", "place"]), "languages")
    families: dict[str, list[str]] = {}
    for lang in sorted(r.lang for r in rows.select("lang").distinct().collect()):
        families.setdefault(family_of(lang), []).append(lang)
    jobs = [(lang, name, "", name == own) for own, langs in families.items() for lang in langs for name in families if len(families) > 1]
    jobs += [(lang, a, b, lang == a) for langs in families.values() for i, a in enumerate(langs) for b in langs[i + 1 :] for lang in (a, b)]
    model = Model(families, {}, {})
    if not jobs:
        return model
    asked = docs.sparkSession.createDataFrame(jobs, "lang string, first string, second string, yes boolean")
    fitted = rows.join(F.broadcast(asked), "lang").groupBy("first", "second").applyInArrow(
        lambda table: _fit_group(table), "first string, second string, feature array<int>, weight array<float>, rest array<double>"
    )
    for row in fitted.toLocalIterator():
        machine = Machine(np.zeros(1 << BITS, np.float32), *row.rest)
        machine.weights[np.array(row.feature, np.int64)] = row.weight
        if row.second:
            model.of_pair[row.first, row.second] = machine
        else:
            model.of_family[row.first] = machine
    return model


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with language (a learned one, or ``und``) and language_score (0 to 1), by each whole text alone.

    A null text, or one without any letter, is ``und`` with a score of 0; so is every text if nothing was learned. Rows and
    other columns stay as they are, whatever their names, but for columns of the two names given here, which are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = sent.value.predict(text)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    made = ("language", "language_score")
    if not model.families:
        return docs.select(*others(docs.columns, *made), F.lit("und").alias("language"), F.lit(0.0).alias("language_score"))
    (name,) = unused([*docs.columns, *made], "language_found")
    done = docs.withColumn(name, predict(F.col("text")))
    known = F.col("text").isNotNull() & _letters()
    return done.select(
        *others(docs.columns, *made), F.when(known, F.col(f"{name}.lang")).otherwise("und").alias("language"), F.when(known, F.col(f"{name}.score")).otherwise(0.0).alias("language_score")
    )


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: by the CRC of its id, a null one as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
