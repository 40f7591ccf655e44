"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_pass, blocks, cut_lineage
from evalspark.llm.mixing import draw
from evalspark.session import broadcast_if_small

#: Families of ISO 639-1 languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la lad oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa si sd ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt ti",
    "austronesian": "id jv mg ms su tl",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "iranian": "fa ku ps tg",
    "sinitic": "yue zh",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
UNKNOWN = "und"
BITS = 14
SIZE = 1 << BITS
_ORDERS = (1, 2, 3, 4)
_SEEDS = np.random.default_rng(5).integers(1, 2**31, len(_ORDERS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Bytes that end a run of letters: all of ASCII but letters.
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"={lang}")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows × 2^BITS features, whether a text has a letter) of whole texts.

    Features are square roots of the shares of hashed byte n-grams of 1 to 4 bytes, over lower-cased letters with one
    sign for anything between words; so every row with a letter has length 1, however long its text is.
    """
    raw = [t.lower().encode() for t in texts]
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for lo, hi in blocks(raw, 1 << 19):
        x = _PLAIN[np.frombuffer(b"  ".join(raw[lo:hi]) + b"     ", dtype=np.uint8)]
        owner = np.repeat(np.arange(hi - lo), [len(t) + 2 for t in raw[lo:hi]])
        n = len(owner)
        code = x[:n].copy()
        flat = np.zeros((hi - lo) * SIZE, dtype=np.int64)
        for order, seed in zip(_ORDERS, _SEEDS, strict=True):
            if order > 1:
                code = (code << np.uint32(8)) | x[order - 1 : n + order - 1]
            gap = (x[:n] == 32) & ((x[1 : n + 1] == 32) | (order == 1))
            cell = (code * seed) >> np.uint32(32 - BITS)
            keep = ~gap
            flat += np.bincount(owner[keep] * SIZE + cell[keep], minlength=len(flat))
        counts = flat.reshape(hi - lo, SIZE)
        total = counts.sum(axis=1, keepdims=True)
        out[lo:hi] = np.sqrt(counts / np.maximum(total, 1))
    return out, np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by dual coordinate descent in a fixed order."""
    x = x.astype(np.float64)
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    square = (x**2).sum(1) + 1 + 0.5 / cost
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w + bias) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w += step * x[i]
                bias += step
    return np.append(w, bias)


def training_sample(docs: DataFrame, per_class: int = 400) -> DataFrame:
    """(lang, rank, text): at most ``per_class`` documents of each language, those with the least hash draws.

    Only keys are sorted; each task drops all but its own least draws before the shuffle, so a language with most of
    the rows is no hot group.
    """
    keys = docs.select("doc_id", "lang").withColumn("u", draw("langid", "doc_id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    chosen = keys.withColumn("rank", rank).where(F.col("rank") <= per_class).select("doc_id", "lang", "rank")
    return docs.select("doc_id", "lang", "text").join(broadcast_if_small(cut_lineage(chosen)), ["doc_id", "lang"])


class Model:
    """Machines of the two levels: between families, and between the languages of a family."""

    def __init__(self, langs: list[str], weights: dict[tuple[str, str, str], np.ndarray]):
        self.tree: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.tree.setdefault(family(lang), []).append(lang)
        self.pairs = sorted(weights)
        self.w = np.array([weights[p][:-1] for p in self.pairs], dtype=np.float32).reshape(len(self.pairs), SIZE)
        self.b = np.array([weights[p][-1] for p in self.pairs], dtype=np.float32)

    def _vote(self, margins: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner (most duels won, then the larger sum of margins) and the mean probability of its duels."""
        wins, sums = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        for (lv, a, b), m in zip(self.pairs, margins.T, strict=True):
            if lv == level and a in names and b in names:
                p = 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
                for name, won, share in ((a, m >= 0, p), (b, m < 0, 1 - p)):
                    wins[:, names.index(name)] += won
                    sums[:, names.index(name)] += share
        best = np.argmax(wins + sums / (len(names) + 1), axis=1)
        return best, sums[np.arange(len(best)), best] / max(len(names) - 1, 1) if len(names) > 1 else np.ones(len(best))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for a text without a letter, or if nothing was learned."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.tree:
            return lang, score
        for at in range(0, len(texts), 64):
            x, has = features(texts[at : at + 64])
            margins = x @ self.w.T + self.b if self.pairs else np.zeros((len(x), 0))
            families = sorted(self.tree)
            top, p_top = self._vote(margins, "family", families)
            for k in np.unique(top[has]) if has.any() else []:
                own = np.flatnonzero((top == k) & has)
                langs = self.tree[families[k]]
                best, p = self._vote(margins[own], families[k], langs)
                for i, j, q in zip(own, best, p * p_top[own], strict=True):
                    lang[at + i], score[at + i] = langs[j], float(q)
        return lang, score


def fit(sample: DataFrame, per_class: int = 400) -> Model:
    """One machine for each pair of families and each pair of languages within a family, fitted in parallel.

    ``sample`` is bounded: ``per_class`` rows a language. A family is represented by as many rows as a language,
    shared among its languages. Only the weights, 64 KB a machine, reach the driver.
    """
    spark = sample.sparkSession
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    tree: dict[str, list[str]] = {}
    for lang in langs:
        tree.setdefault(family(lang), []).append(lang)
    duels = [("family", a, b, lang, 1 if lang in tree[a] else -1, max(1, per_class // len(tree[family(lang)]))) for a, b in itertools.combinations(sorted(tree), 2) for lang in tree[a] + tree[b]]
    duels += [(f, a, b, lang, 1 if lang == a else -1, per_class) for f, own in tree.items() for a, b in itertools.combinations(own, 2) for lang in (a, b)]
    if not duels:
        return Model(langs, {})
    plan = spark.createDataFrame(duels, "level string, a string, b string, lang string, y int, most int")
    rows = sample.join(F.broadcast(plan), "lang").where(F.col("rank") <= F.col("most")).select("level", "a", "b", "y", "rank", "lang", "text")

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by([("lang", "ascending"), ("rank", "ascending")])
        x, has = features(t["text"].to_pylist())
        y = t["y"].to_numpy().astype(np.float64)
        w = linear_svm(x[has], y[has])
        key = {c: t[c].slice(0, 1).to_pylist() for c in ("level", "a", "b")}
        return pa.table({**key, "w": pa.array([w.astype(np.float32)], pa.list_(pa.float32()))})

    fitted = rows.groupBy("level", "a", "b").applyInArrow(train, "level string, a string, b string, w array<float>").collect()
    return Model(langs, {(r["level"], r["a"], r["b"]): np.array(r["w"], dtype=np.float32) for r in fitted})


def identify(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred and score of every whole text; a null text is ``und``. Repeated rows stay."""
    model = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", lang_pred string, score double"

    def run(cols: dict) -> dict:
        lang, score = model.value.predict([t or "" for t in cols["text"]])
        return {c: cols[c] for c in keep} | {"lang_pred": lang, "score": score}

    return arrow_pass(df.select(*keep, "text"), run, schema)
