"""Quality rules from tokeniser fertility: public vocabularies measure texts, bands per language reject the odd ones."""

from __future__ import annotations

import math
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Memory, arrow_pass, blocks, cut_lineage
from evalspark.session import broadcast_if_small

#: Words whose tokens a worker remembers, at most.
REMEMBERED = 1_000_000
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Measures and the least half-width of their band, in the measure's own unit.
MEASURES = {"chars_per_token": 0.3, "letters_per_token": 0.3, "fallback_share": 0.1, "token_entropy": 1.0}


class WordTokens:
    """Tokens of single words in two vocabularies, remembered by the word."""

    def __init__(self, bpe_path: str, piece_path: str):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(bpe_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        size = self.pieces.get_piece_size()
        self.fallback = np.array([int(self.pieces.is_byte(i)) for i in range(size)])
        self.begins = np.array([self.pieces.id_to_piece(i).startswith("▁") for i in range(size)])
        self.ids, self.counts = Memory(REMEMBERED), Memory(REMEMBERED)

    def learn(self, words: set[bytes]) -> None:
        """Ids of new words in the first vocabulary; and, in one number, their letters or digits, their pieces in the
        second and how many of these are byte fallbacks, each in 64 bits, so that sums of numbers hold three sums."""
        self.ids.make_room(len(words))
        self.counts.make_room(len(words))
        new = [w for w in words if not (w in self.ids or w in self.ids.old)]
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            texts = [w.decode() for w in part]
            for w, t, (n, bytes_) in zip(part, texts, self._pieces(texts), strict=True):
                self.ids[w] = array("I", self.bpe.encode_ordinary(" " + t)).tobytes()
                letters = len(t) if t.isalnum() else sum(map(str.isalnum, t))
                self.counts[w] = letters + (n << 64) + (bytes_ << 128)

    def _pieces(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pieces, byte fallbacks) of each word: words go through the model as one text, and every piece that begins
        with a space begins a word; if that does not give the number of words, they go one by one."""
        ids = np.array(self.pieces.encode(" ".join(texts), num_threads=1))
        first = self.begins[ids]
        if first.sum() != len(texts) or not first[0]:
            each = self.pieces.encode(texts, num_threads=1)
            return [(len(p), int(self.fallback[p].sum()) if p else 0) for p in each]
        word = np.cumsum(first) - 1
        return list(zip(np.bincount(word).tolist(), np.bincount(word, weights=self.fallback[ids]).astype(int).tolist(), strict=True))


_loaded: dict[tuple[str, str], WordTokens] = {}


def _word_tokens(bpe_path: str, piece_path: str) -> WordTokens:
    key = (bpe_path, piece_path)
    if key not in _loaded:
        _loaded[key] = WordTokens(*key)
    return _loaded[key]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included."""
    if len(words) <= width:
        return 0
    place = {w: i for i, w in enumerate(set(words))}
    code = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    window = code[: len(code) - width + 1]
    for j in range(1, width):
        both = window * len(place) + code[j : len(code) - width + 1 + j]
        window = np.unique(both, return_inverse=True)[1].reshape(-1)
    often = np.bincount(window)[window] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str, tokens: WordTokens) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, tokens, letters per token, characters per token,
    byte-fallback share, token entropy in bits) of one whole text."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    base = (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words))
    if not words:
        return (*base, 0, None, None, None, None)
    try:
        ids = b"".join(map(tokens.ids.__getitem__, words))
        sums = sum(map(tokens.counts.__getitem__, words))
    except KeyError:
        tokens.learn(set(words))
        ids = b"".join(map(tokens.ids.__getitem__, words))
        sums = sum(map(tokens.counts.__getitem__, words))
    ids = np.sort(np.frombuffer(ids, dtype=np.uint32))
    n = len(ids)
    counts = np.diff(np.flatnonzero(np.diff(ids, prepend=np.uint32(0xFFFFFFFF))), append=n)
    entropy = math.log2(n) - float((counts * np.log2(counts)).sum()) / n
    low = (1 << 64) - 1
    letters, pieces, fallback = sums & low, sums >> 64 & low, sums >> 128
    return (*base, n, letters / n, chars / n, fallback / max(pieces, 1), max(entropy, 0.0))


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "letters_per_token", "chars_per_token", "fallback_share", "token_entropy")


def measured(df: DataFrame, bpe_path: str, piece_path: str, text: str = "text", group: str = "lang") -> DataFrame:
    """doc_id, band group and measures of every whole text; a null text is empty and has null measures.

    Each word is tokenised on its own, with the space before it, so that ids depend on the word alone.
    """

    def run(cols: dict) -> dict:
        tokens = _word_tokens(bpe_path, piece_path)
        texts = [t or "" for t in cols["text"]]
        rows = []
        for lo, hi in blocks(texts, 1 << 21):
            tokens.learn(set().union(*[t.encode().split() for t in texts[lo:hi]]))
            rows += [measure(t, tokens) for t in texts[lo:hi]]
        rows = zip(*rows, strict=True)
        return {"doc_id": cols["doc_id"], "band_group": cols["band_group"]} | dict(zip(_COLUMNS, map(list, rows), strict=True))

    schema = "doc_id long, band_group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, letters_per_token double, chars_per_token double, fallback_share double, token_entropy double"
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(group).cast("string").alias("band_group"))
    return arrow_pass(own, run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(rows: DataFrame, width: float = 6.0, grid: int = 200, least_rows: int = 50) -> DataFrame:
    """Band of each measure per group, from all rows that pass the base rules: median ± ``width`` quartile ranges.

    Quartiles come from a histogram with ``grid`` steps a unit, so that they are exact on that grid, the same in every
    run, and counted before the shuffle. Groups of fewer than ``least_rows`` rows take the band of all rows, which is
    the row with __all set.
    """
    ok = rows.where(~base_failed())
    cells = ok.select("band_group", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(F.col(m) * grid).cast("long").alias("cell")) for m in MEASURES])).alias("x"))
    counted = cells.groupBy("band_group", "x.m", "x.cell").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted)
    both = counted.withColumn("__all", F.lit(False)).unionByName(counted.groupBy("m", "cell").agg(F.sum("n").alias("n")).withColumn("band_group", F.lit(None).cast("string")).withColumn("__all", F.lit(True)))
    upto = Window.partitionBy("__all", "band_group", "m").orderBy("cell")
    total = F.sum("n").over(Window.partitionBy("__all", "band_group", "m"))
    ranked = both.withColumn("upto", F.sum("n").over(upto)).withColumn("total", total)
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("cell"))) / grid
    quart = ranked.groupBy("__all", "band_group", "m").agg(F.max("total").alias("total"), at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    half = F.greatest(width * (F.col("c") - F.col("a")), F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("m")))
    quart = quart.where(F.col("__all") | (F.col("total") >= least_rows)).withColumn("half", half)
    out = quart.groupBy("__all", "band_group")
    pick = [F.max(F.when(F.col("m") == m, F.col("b") - F.col("half"))).alias(f"{m}_low") for m in MEASURES] + [F.max(F.when(F.col("m") == m, F.col("b") + F.col("half"))).alias(f"{m}_high") for m in MEASURES]
    return cut_lineage(out.agg(*pick))


def judged(rows: DataFrame, width: float = 6.0) -> DataFrame:
    """``measured`` rows with base_failed and kept.

    Rejected: rows that fail the base rules, too few or too many characters or letters a token, too much byte fallback, too little
    token entropy, each against the band of the row's group (null is a group). The corpus-wide band stands in for
    groups without one; if there is none at all, nothing more is rejected.
    """
    rows = cut_lineage(rows)
    limits = bands(rows, width)
    names = [c for c in limits.columns if c not in ("__all", "band_group")]
    own = limits.where(~F.col("__all")).select(F.col("band_group").alias("__g"), *names)
    every = limits.where("__all").select(*[F.col(c).alias(f"__{c}") for c in names]).first() or {}
    out = rows.join(broadcast_if_small(own), F.col("band_group").eqNullSafe(F.col("__g")), "left").drop("__g")
    limit = lambda c: F.coalesce(F.col(c), F.lit(every[f"__{c}"] if every else None).cast("double"))
    odd = F.lit(False)
    for m in ("chars_per_token", "letters_per_token"):
        odd = odd | (F.col(m) < limit(f"{m}_low")) | (F.col(m) > limit(f"{m}_high"))
    odd = odd | (F.col("fallback_share") > limit("fallback_share_high")) | (F.col("token_entropy") < limit("token_entropy_low"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~F.coalesce(odd, F.lit(False))).drop(*names)
