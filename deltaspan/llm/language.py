"""Language identification: the family first, then one-versus-one linear machines inside it.

Texts become counts of hashed byte n-grams (lower case, two and three bytes),
scaled to unit length after a square root. Families come from a table of common
languages; a language that it doesn't name is a family of its own. A linear
support vector machine for each family against the rest picks the family, and
one for each pair of its languages votes inside it. All machines are trained in
numpy on a bounded sample: at most PER_LANG rows of each of the MAX_LANGS most
frequent languages and at most MAX_ROWS in all, evenly, those with the smallest
hash of id. Rows are kept as sparse counts, so the driver holds some 100 MB at
most. Every whole text is predicted.

Null texts and texts without a letter are `und` with score 0, and so is every
text if nothing was learnt; between equal votes the first language by name wins.
Rows keep their number: ids may be null (never learnt from) or repeat, an empty
table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.llm.common import crc_mod, ship, table

UND = "und"
DIM = 1 << 12
PER_LANG, MAX_LANGS, MAX_ROWS, EPOCHS, SEED = 1200, 512, 19_200, 12, 3
#: Bytes of a text that are hashed at a time.
SPAN = 1 << 20
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn ur pa gu mr ne si",
    "turkic": "tr az kk uz ky tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_PLAIN = re.compile("[a-z]", re.IGNORECASE | re.ASCII)


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter; numerals such as ² or ½ aren't."""
    return bool(text) and (_PLAIN.search(text) is not None or any(map(str.isalpha, text)))


def vector(text: str) -> np.ndarray:
    """Of a whole text: float32 of unit length, or zeros for one of fewer than two bytes."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    count, shift = np.zeros(DIM, np.int64), np.uint32(20)  # DIM is 2 ** 12
    for at in range(0, max(len(data) - 1, 0), SPAN):
        part = data[at : at + SPAN + 2].astype(np.uint32)
        two = part[:-1] * np.uint32(0x9E3B) + part[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + part[2:] * np.uint32(0x27D4EB2F)
        for x in (two[:SPAN], three[:SPAN]):
            count += np.bincount(((x * np.uint32(0x9E3779B1)) >> shift).astype(np.int64), minlength=DIM)
    out = np.sqrt(count.astype(np.float32))
    norm = np.sqrt(float(count.sum()))
    return out / np.float32(norm) if norm else out


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's vector."""
    x = vector(text)
    at = np.flatnonzero(x)
    return at.astype(np.uint16), x[at]


def machines(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator, c: float = 10.0, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and offsets of linear support vector machines (squared hinge) by dual coordinate descent.

    One machine for each row of `y`, whose entries are -1 or 1; both signs weigh
    alike. All machines see the rows in one order.
    """
    m, n = y.shape
    w, b = np.zeros((m, DIM + 1)), np.zeros((n, m))
    positive = np.maximum((y > 0).sum(1), 1)
    negative = np.maximum(n - (y > 0).sum(1), 1)
    diag = {1.0: positive / (c * n), -1.0: negative / (c * n)}
    norms = [float(v @ v) + 1 for _, v in rows]
    for _ in range(epochs):
        for i in rng.permutation(n):
            at, v = rows[i]
            sign = y[:, i]
            d = np.where(sign > 0, diag[1.0], diag[-1.0])
            g = sign * (w[:, at] @ v + w[:, -1]) - 1 + b[i] * d
            new = np.maximum(b[i] - g / (norms[i] + d), 0.0)
            step = (new - b[i]) * sign
            moved = np.flatnonzero(step)
            if len(moved):
                w[moved[:, None], at] += step[moved, None] * v
                w[moved, -1] += step[moved]
                b[i] = new
    return w


@dataclass
class Model:
    langs: list[str]
    families: dict[str, list[str]]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and a score from 0 to 1; `und` and 0 without a letter or without any learnt language."""
        usable = [has_letter(t) for t in texts]
        x = np.array([vector(t) for t, u in zip(texts, usable) if u], np.float32).reshape(-1, DIM)
        found = self._predict(x) if self.langs and len(x) else [(UND, 0.0)] * len(x)
        answers = iter(found)
        out = [next(answers) if u else (UND, 0.0) for u in usable]
        return [a for a, _ in out], [s for _, s in out]

    def _margin(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    def _predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        names = list(self.families)
        if len(names) > 1:
            m = np.stack([self._margin(x, self.first[f]) for f in names], 1)
            e = np.exp(2 * (m - m.max(1, keepdims=True)))
            family, sure = m.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
        else:
            family, sure = np.zeros(len(x), int), np.ones(len(x))
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(x)
        for k, name in enumerate(names):
            rows, langs = np.flatnonzero(family == k), self.families[name]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                p = 1 / (1 + np.exp(-np.clip(2 * self._margin(x[rows], self.pairs[langs[a], langs[b]]), -30, 30)))
                votes[:, a] += p
                votes[:, b] += 1 - p
            best = votes.argmax(1)
            inside = votes.max(1) / max(len(langs) - 1, 1) if len(langs) > 1 else np.ones(len(rows))
            for r, i in enumerate(rows):
                out[i] = langs[best[r]], float(min(1.0, sure[i] * inside[r]))
        return out


def fit(sample: list[tuple[str, str]]) -> Model:
    """From (text, lang) rows."""
    rows = [(t, g) for t, g in sample if has_letter(t)]
    langs = sorted({g for _, g in rows})
    families: dict[str, list[str]] = {}
    for g in langs:
        families.setdefault(FAMILY_OF.get(g.lower(), f"only {g}"), []).append(g)
    model = Model(langs, families)
    x = [sparse(t) for t, _ in rows]
    lang = np.array([g for _, g in rows])
    rng = np.random.default_rng(SEED)
    if len(families) > 1:
        found = machines(x, np.array([np.where(np.isin(lang, own), 1.0, -1.0) for own in families.values()]), rng)
        model.first = dict(zip(families, found.astype(np.float32)))
    for own in families.values():
        for a, b in combinations(own, 2):
            at = np.flatnonzero((lang == a) | (lang == b))
            model.pairs[a, b] = machines([x[i] for i in at], np.where(lang[at] == a, 1.0, -1.0)[None], rng)[0].astype(np.float32)
    return model


def usable(doc_id):
    """Rows whose language may be learnt from."""
    return crc_mod(doc_id, 3) != 1


def training_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, max_rows: int = MAX_ROWS) -> list[tuple[str, str]]:
    """At most `per_lang` rows of each of the `max_langs` most frequent languages and `max_rows` of all.

    Rows are counted first, and hashes cut so that some twice as many rows of a
    language are left as are taken; ranks are then given among those only.
    """
    d = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("d_id").isNotNull() & usable(F.col("d_id")))
    langs = {r.lang: r["count"] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not langs:
        return []
    take = max(1, min(per_lang, max_rows // len(langs)))
    h = F.pmod(F.xxhash64(F.lit("lang"), "d_id"), F.lit(1 << 30))
    # The spare leaves fewer than `take` rows once in many billion times.
    room = F.create_map(*[F.lit(x) for g, n in langs.items() for x in (g, int((1 << 30) * min(1.0, (2 * take + 200) / n)))])
    d = d.where(F.col("lang").isin(list(langs)) & (h < F.try_element_at(room, F.col("lang"))))
    ranked = d.select("d_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(h, "d_id")).alias("rank_"))
    kept = ranked.where(F.col("rank_") <= take).select("d_id", F.col("lang").alias("kept_lang")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(kept), F.col("t_id") == F.col("d_id")).select("t_id", "text", "kept_lang")
    return [(r.text, r.kept_lang) for r in sorted(rows.toLocalIterator(), key=lambda r: (r.t_id, r.kept_lang, r.text or "")) if r.text]


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every whole text; nothing is shuffled."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lang, score = held.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs))).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
