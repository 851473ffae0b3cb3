"""Language identification by script ranges and Viterbi decoding (operator 5).

A word's letters name a script, and only languages whose training text uses that script are candidates.  Every
word gets a log score per candidate from its letter n-grams; Viterbi over the words, with a penalty for each
change of language, labels spans of mixed-language text.  A constant path is proved best without the recursion
wherever no other language gains more than the penalty over any run of words, which settles most documents.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import held_out, worker_state

#: Training documents to a language (in expectation, by id hash); longest n-gram; least count of an n-gram.
MAX_DOCS, ORDER, MIN_COUNT = 1500, 3, 2
#: Share of a language's letters that a script must reach to be one of its scripts.
MIN_SCRIPT = 0.01
#: Cost in nats of a change of language between two words.
SWITCH = 8.0
#: Words remembered by a worker, and codes of n-grams that may take a plain table.
MEMO, DIRECT = 300_000, 1 << 22
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+").findall
#: First code point of each range, and its script; other letters count as script "other".
SCRIPTS = [
    (0x0041, "Latin"), (0x0250, "other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script(char: str) -> str:
    at = bisect.bisect_right(_STARTS, ord(char)) - 1
    return SCRIPTS[at][1] if at >= 0 else "other"


def grams(word: str) -> list[str]:
    """The word itself (marked) and its n-grams with its ends marked."""
    w = f"^{word}$"
    out, now = [f"={word}", *word], list(w)
    for n in range(1, ORDER):
        now = list(map(add, now, w[n:]))   # every gram with the letter after it
        out += now
    return out


class GramCoder:
    """Rows of the n-grams of many words at once: a gram's code is its letters' numbers in base ``k``, and codes are looked up
    in whole arrays.  Letters that no learned n-gram has are 0 and make a gram unseen."""

    def __init__(self, rows: dict[str, int]):
        self.rows, self.unseen = rows, len(rows)
        grams_ = [(g, i) for g, i in rows.items() if g[0] != "="]
        self.letters = np.unique([0, *(ord(c) for c in set(chain.from_iterable(g for g, _ in grams_)))]).astype(np.int64)
        self.k, self.tables = len(self.letters), []
        for n in range(1, ORDER + 1):
            own = [(g, i) for g, i in grams_ if len(g) == n]
            number = self.numbers("".join(g for g, _ in own)).reshape(-1, n)
            code = number @ (np.int64(self.k) ** np.arange(n - 1, -1, -1, dtype=np.int64))
            row = np.array([i for _, i in own], np.int64)
            if self.k**n <= DIRECT:
                table = np.full(self.k**n, self.unseen, np.int32)
                table[code] = row
                self.tables.append((None, table))
            else:
                order = np.argsort(code)
                self.tables.append((code[order], row[order]))

    def numbers(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), self.k - 1)
        return np.where(self.letters[at] == points, at, 0)

    def found(self, n: int, code: np.ndarray) -> np.ndarray:
        codes, rows = self.tables[n - 1]
        if codes is None:
            return rows[code]
        if not len(codes):
            return np.full(len(code), self.unseen)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, rows[at], self.unseen)

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words' grams one after another, each word's in the order of ``grams``, and where each word starts."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number = self.numbers("".join([f"^{w}$" for w in words]))
        counts = [sizes, *(sizes + 3 - n for n in range(2, ORDER + 1))]
        all_ = 1 + sum(counts)
        starts = np.cumsum(all_) - all_
        out = np.full(int(all_.sum()), self.unseen, np.int64)
        out[starts] = np.fromiter(map(self.rows.get, [f"={w}" for w in words], repeat(self.unseen)), np.int64, len(words))
        before, code = starts + 1, number
        first = np.cumsum(sizes + 2) - (sizes + 2)   # of each word in ``number``
        for n, count in enumerate(counts, 1):
            if n > 1:
                code = code[:-1] * self.k + number[n - 1:]
            many = np.maximum(count, 0)
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out[np.repeat(before, many) + step] = self.found(n, code[np.repeat(first + (n == 1), many) + step])
            before = before + many
        return out, starts


@dataclass
class LanguageModel:
    """Log scores of n-grams (rows) by language (columns), the score of an unseen one, and scripts by language."""

    langs: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)
    logp: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    scripts: dict[str, list[bool]] = field(default_factory=dict)
    coder: GramCoder | None = field(default=None, compare=False)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log scores (words by languages) over all n-grams of each word, -inf outside the candidates of its script; a script
        of no language makes every language a non-candidate."""
        if self.coder is None:
            self.coder = GramCoder(self.rows)
        at, starts = self.coder.places(words)
        s = np.add.reduceat(self.logp[at], starts, axis=0) / ORDER
        none, firsts = [False] * len(self.langs), [w[0] for w in words]
        fits = {c: self.scripts.get(script(c), none) for c in set(firsts)}
        return np.where(np.array([fits[c] for c in firsts]), s, -np.inf)


class WordTable(dict):
    """Row number of each word in ``scores`` and ``post`` (posteriors), filled as words are met."""

    def __init__(self, model: LanguageModel, limit: int = MEMO):
        super().__init__()
        self.model, self.limit = model, limit
        self.scores = np.zeros((limit, len(model.langs)))
        self.post = np.zeros((limit, len(model.langs)))

    def fill(self, words: list[str]) -> None:
        """Enter the words of a text that are not held yet."""
        new = [w for w in set(words) if w not in self]
        if not new:
            return
        size = len(self) + len(new)
        if size > len(self.scores):  # a very long text may outgrow the memo; it is cleared between texts
            more = np.zeros((size, self.scores.shape[1]))
            self.scores, self.post = (np.concatenate([a, more]) for a in (self.scores, self.post))
        s = self.model.word_scores(new)
        top = s.max(axis=1, keepdims=True)
        none = ~np.isfinite(top[:, 0])
        e = np.exp(s - np.where(np.isfinite(top), top, 0.0))
        at = slice(len(self), size)
        self.post[at] = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)
        self.scores[at] = np.maximum(s, top - 50.0)  # a non-candidate costs 50 nats more than the best
        self.scores[at][none] = np.nan
        self.update(zip(new, range(at.start, size), strict=True))

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.clear()
            self.scores, self.post = self.scores[:self.limit], self.post[:self.limit]


def _constant(s: np.ndarray, best: int, switch: float) -> bool:
    """Whether no path beats staying with ``best``: leaving it inside the text costs two changes at least, at an end one,
    and gains at most what the best other language gains word by word over a run of words."""
    other = np.delete(s, best, axis=1)
    if not other.shape[1]:
        return True
    gain = np.concatenate([[0.0], np.cumsum(other.max(axis=1) - s[:, best])])
    least = np.minimum.accumulate(gain)
    return gain.max() <= switch and gain[-1] - least[-1] <= switch and (gain - least).max() <= 2 * switch


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each row of ``s`` (words by languages) under a penalty for each change."""
    best = int(np.argmax(s.sum(axis=0)))
    if _constant(s, best, switch):
        return np.full(len(s), best)
    rows = s.tolist()
    value, back, own = rows[0], [], range(s.shape[1])
    for row in rows[1:]:
        high = max(value)
        top, least = value.index(high), high - switch
        back.append([k if value[k] >= least else top for k in own])
        value = [(v if v >= least else least) + r for v, r in zip(value, row, strict=True)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def label(words: list[str], table: WordTable, switch: float = SWITCH) -> tuple[str, float, list[tuple[str, int, int]]]:
    """Main language (most letters), its score and the spans (language, first word, last word) of a text."""
    if not words or not table.model.langs:
        return UNKNOWN, 0.0, []
    table.trim()
    table.fill(words)
    idx = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    s = table.scores[idx]
    known = np.flatnonzero(~np.isnan(s[:, 0]))
    if not len(known):
        return table.model.langs[0], 0.0, []
    path = viterbi(s[known], switch)
    cuts = np.flatnonzero(np.diff(path)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(path)]]) - 1
    spans = [(table.model.langs[path[a]], int(known[a]), int(known[b])) for a, b in zip(first, last, strict=True)]
    if len(spans) == 1:
        main = int(path[0])
    else:
        letters = np.array([len(words[i]) for i in known])
        main = int(np.argmax(np.bincount(path, letters, len(table.model.langs))))
    score = float(table.post[idx[known], main].mean())
    return table.model.langs[main], min(1.0, max(0.0, score)), spans


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_DOCS) -> LanguageModel:
    """Learn from rows that have an id and a language and are not held out: about ``max_docs`` to a language, those
    of lowest id hash, whole texts.  Null texts add nothing; without such rows the model knows no language."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel()
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, max_docs / n))))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met.setdefault(lang, Counter()).update(WORDS(text.lower()))
        for lang, words in met.items():
            c: Counter = Counter()
            for w, n in words.items():
                for g in grams(w):
                    c[g] += n
                c[f"/{script(w[0])}"] += n * len(w)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    met = (rows.filter(chance < share[F.col("lang")]).select("lang", "text")
           .mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
           .filter((F.col("n") >= MIN_COUNT) | F.col("gram").startswith("/")).collect())
    langs = sorted(counts)
    col = {x: i for i, x in enumerate(langs)}
    names = sorted({r["gram"] for r in met if r["gram"][0] != "/"})
    at = {g: i for i, g in enumerate(names)}
    table, letters = np.zeros((len(names) + 1, len(langs))), {}
    for r in met:
        if r["gram"][0] == "/":
            letters.setdefault(r["gram"][1:], np.zeros(len(langs)))[col[r["lang"]]] += r["n"]
        else:
            table[at[r["gram"]], col[r["lang"]]] += r["n"]
    logp = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    total = np.maximum(1.0, sum(letters.values(), np.zeros(len(langs))))
    scripts = {k: [bool(x) for x in v / total >= MIN_SCRIPT] for k, v in letters.items()}
    return LanguageModel(langs, at, logp, {k: v for k, v in scripts.items() if any(v)})


def predict_column(model, name: str, text: Column, switch: float = SWITCH) -> Column:
    """Struct of ``lang_pred``, ``score`` and ``spans`` for each whole text; ``model`` is a broadcast of the model's fields and
    ``name`` tells workers whether the word table they hold was filled from it.

    A text that is null or has no letter is ``und`` with score 0 and no span; a text whose letters belong to no
    learned script gets the first language with score 0.
    """
    from pyspark.sql.functions import arrow_udf

    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    out = "struct<lang_pred:string,score:double,spans:array<struct<lang:string,first:int,last:int>>>"

    @arrow_udf(out)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = worker_state("language")
        if state.get("name") != name:
            state.update(name=name, table=WordTable(LanguageModel(*model.value)))
        table = state["table"]
        for batch in batches:
            got = [label(WORDS((t or "").lower()), table, switch) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([[{"lang": a, "first": b, "last": c} for a, b, c in g[2]] for g in got], span)],
                ["lang_pred", "score", "spans"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language", switch: float = SWITCH) -> DataFrame:
    """``docs`` with struct column ``out`` (see ``predict_column``); an existing column of that name is replaced."""
    # plain values: a broadcast is pickled by reference, and executors need not have this package
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.rows, model.logp, model.scripts))
    return docs.withColumn(out, predict_column(shared, uuid.uuid4().hex, F.col(f"`{text_col}`"), switch))
