"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in that sample: few phrases mean that the text repeats what the language says. The number of
phrases a letter, times the logarithm of the sample's length, estimates the cross entropy; the language with the least
wins. All languages, and windows of WINDOW letters of all texts of a batch, are parsed side by side: each window at first
as if a phrase began with it, and then, from the state in which the window before it really ends, up to where both parses
are in one state, from where on they agree. So phrases cross the borders of windows, and the result is that of one parse
of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, beside, documents, held_out, texts_of

#: Letters of training text of each language, and how many a document gives at most.
SAMPLE_LETTERS = 20_000
DOCUMENT_LETTERS = 400
#: Rows of each language among which that text is found.
SAMPLE_ROWS = 400
#: Languages learnt at most, those with the most rows; a column of free text has no more models than that.
LANGUAGES = 256
WINDOW = 512
#: Letters after which lanes are looked at for those that met.
CHECK = 16
UNKNOWN = "und"
#: Codes of what stands between words, and of letters that no sample has.
GAP, STRANGE = 0, 1


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _IS_LETTER


_IS_LETTER: np.ndarray | None = None


def normalise(text: str) -> str:
    """Lower-case letters; a blank for everything else between them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: str, code: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions [state, letter] of the suffix automaton of text, -1 where there is none; how often each state's strings occur."""
    link, length, to, count = [-1], [0], [{}], [0]
    last = 0
    for c in text:
        k = code[c]
        cur = len(to)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        count.append(1)
        p = last
        while p >= 0 and k not in to[p]:
            to[p][k] = cur
            p = link[p]
        if p >= 0:
            q = to[p][k]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(to)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(dict(to[q]))
                count.append(0)
                while p >= 0 and to[p].get(k) == q:
                    to[p][k] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for s in sorted(range(1, len(to)), key=length.__getitem__, reverse=True):
        count[link[s]] += count[s]
    table = np.full((len(to), len(code) + 2), -1, np.int64)
    for s, edges in enumerate(to):
        for k, t in edges.items():
            table[s, k] = t
    return table, np.array(count, np.float64)


@dataclass
class Model:
    languages: list[str]
    letters: dict[str, int]  # code of each letter of the samples
    steps: np.ndarray  # (next state's row << 2) | phrases that end, for each row and code
    roots: np.ndarray
    rest: np.ndarray  # share of a phrase that a parse ending in a state still counts, for each row / width
    scale: np.ndarray  # log2 of the sample's length

    @classmethod
    def fit(cls, samples: dict[str, str]) -> Model:
        """samples: normalised text of each language."""
        samples = {k: v for k, v in samples.items() if v}
        languages = sorted(samples)
        letters = {c: k + 2 for k, c in enumerate(sorted({c for t in samples.values() for c in t} - {" "}))}
        width = len(letters) + 2
        steps, rest, roots, base = [], [], [], 0
        for name in languages:
            table, count = automaton(samples[name], letters | {" ": GAP})
            width_own = table.shape[1]
            table = np.pad(table, ((0, 0), (0, max(0, width - width_own))), constant_values=-1)[:, :width]
            fresh = table[0]
            ends = (table < 0).astype(np.int64)
            target = np.where(table >= 0, table, np.where(fresh >= 0, fresh, 0)[None, :])
            # from another state, a letter that the sample lacks ends a phrase and is one of its own
            ends[1:] += (table[1:] < 0) & (fresh < 0)[None, :]
            steps.append(((((target + base) * width) << 2) | ends).reshape(-1))
            n = max(2, len(samples[name]))
            own = np.log(n / np.maximum(count, 1)) / np.log(n)
            own[0] = 0
            rest.append(own)
            roots.append(base * width)
            base += len(table)
        kind = np.int32 if base * width < 1 << 28 else np.int64
        return cls(languages, letters, np.concatenate(steps).astype(kind) if steps else np.zeros(0, kind), np.array(roots, kind), np.concatenate(rest) if rest else np.zeros(0), np.array([np.log2(max(2, len(samples[k]))) for k in languages]))

    def codes(self) -> np.ndarray:
        """Code of each code point; those between words have GAP."""
        out = np.where(_letters(), STRANGE, GAP).astype(np.uint8 if len(self.letters) < 250 else np.int32)
        for c, k in self.letters.items():
            out[ord(c)] = k
        return out

    def _carry(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray, nth: np.ndarray, state: np.ndarray, ends: np.ndarray) -> None:
        """Turns state and ends [language, window] of parses that begin anew in each window into those of whole texts.

        From the state that the window before ends in, a window is parsed again till that parse and the one from the root
        meet. A window in which they don't meet ends in another state, so the next one is parsed once more.
        """
        alone, own = state.copy(), ends.copy()
        language, window = np.nonzero(np.repeat((nth > 0)[None], len(state), axis=0))
        while len(window):
            order = np.argsort(-length[window], kind="stable")
            language, window = language[order], window[order]
            changed = np.zeros(len(window), bool)
            # lanes, the longest first; those that met go from time to time, as nothing changes in them any more
            lane, fresh, true, more = np.arange(len(window)), self.roots[language], state[language, window - 1], np.zeros(len(window), np.int32)
            at, sizes, k = begin[window], length[window], 0
            while len(lane):
                for k in range(k, k + CHECK):
                    n = int(np.searchsorted(-sizes, -k, side="left"))
                    if not n:
                        break
                    here = code[at[:n] + k]
                    x, y = self.steps[fresh[:n] + here], self.steps[true[:n] + here]
                    more[:n] += (y & 3) - (x & 3)
                    fresh[:n], true[:n] = x >> 2, y >> 2
                k += 1
                met = fresh == true
                done = met | (sizes <= k)
                which, end = lane[done], np.where(met[done], alone[language[lane[done]], window[lane[done]]], true[done])
                changed[which] = state[language[which], window[which]] != end
                state[language[which], window[which]] = end
                ends[language[which], window[which]] = own[language[which], window[which]] + more[done]
                lane, fresh, true, more, at, sizes = (v[~done] for v in (lane, fresh, true, more, at, sizes))
            following = changed & (window + 1 < len(nth))
            following[following] = nth[window[following] + 1] > 0
            language, window = language[following], window[following] + 1

    def entropies(self, texts: list[str], code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter under each language [text, language]; the number of letters of each text."""
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in raw])
        zero = np.zeros(1, "<u4")
        code = code_of[np.concatenate([y for x in raw for y in (x, zero)])] if texts else np.zeros(0, np.uint8)
        gap = code == GAP
        letters = np.bincount(owner[~gap], minlength=len(texts))
        keep = ~gap
        keep[:-1] |= gap[:-1] & ~gap[1:] & (owner[:-1] == owner[1:])  # the last of several blanks, before a letter of the text
        code, owner = code[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        # windows of each text, the longest first, as the rows of a matrix
        per = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(sizes) - sizes, per) + nth * WINDOW
        length = np.minimum(WINDOW, np.repeat(sizes, per) - nth * WINDOW)
        order = np.argsort(-length, kind="stable")
        state = np.repeat(self.roots[:, None], len(text), axis=1)
        ends = np.zeros(state.shape, np.int32)
        code = code.astype(self.roots.dtype)
        live = np.searchsorted(-length[order], -np.arange(WINDOW), side="left")
        at = begin[order]
        for k in range(int(length[order[0]]) if len(length) else 0):
            n = live[k]
            step = self.steps[state[:, :n] + code[at[:n] + k]]
            ends[:, :n] += step & 3
            state[:, :n] = step >> 2
        back = np.argsort(order)
        state, ends = state[:, back], ends[:, back]
        self._carry(code, begin, length, nth, state, ends)
        phrases = ends.astype(np.float64)
        last = np.append(nth[1:] == 0, True) if len(nth) else np.zeros(0, bool)
        phrases[:, last] += self.rest[state[:, last] // (len(self.letters) + 2)]
        bits = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bits[:, k] = np.bincount(text, weights=phrases[k], minlength=len(texts)) * self.scale[k]
        return bits / np.maximum(sizes, 1)[:, None], letters


def train(docs: DataFrame, sample_letters: int = SAMPLE_LETTERS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on a bounded sample of the rows with text and lang that are not held out.

    Of each of the LANGUAGES most frequent values of lang, about sample_rows rows are taken by a hash of their id, and of
    those, in that order, up to DOCUMENT_LETTERS letters from the middle, till there are sample_letters.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    at = F.xxhash64(F.lit(17), "doc_id").bitwiseAND(0x7FFFFFFF)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model.fit({})
    # a share of the hashes for each language that leaves 1.5 times the rows on average: a bounded number, at any size
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(2**31, int(2**31 * 1.5 * sample_rows / n)))])
    middle = F.expr(f"substring(text, greatest(1, cast(length(text) div 2 - {DOCUMENT_LETTERS} as int)), {2 * DOCUMENT_LETTERS})")
    found = rows.where(F.col("lang").isin(*counts) & (at < share[F.col("lang")])).select("lang", at.alias("at"), "doc_id", middle.alias("text")).collect()
    samples: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.at, r.doc_id, r.text)):
        have = samples.get(r.lang, "")
        if len(have) < sample_letters and (own := normalise(r.text)[:DOCUMENT_LETTERS]):
            samples[r.lang] = (have + " " + own if have else own)[:sample_letters]
    return Model.fit(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and bits_per_letter to docs; columns of these names, in any case, are replaced, and all others
    come back unchanged. An empty table gives no rows; texts of any length are parsed whole.

    Only the text counts. Null texts, texts without a letter, and all texts where nothing was learnt are `und` with
    score 0. Equal entropies go to the language that comes first in order of names. Rows are independent of each other.
    The score is the lead over the second language, as a share of the second's entropy (1 if there is one language).
    """
    spark = docs.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by SAMPLE_LETTERS and LANGUAGES
    codes: list[np.ndarray] = []

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        if not codes:
            codes.append(m.codes())
        n = len(batch)
        bits, letters = m.entropies(texts_of(batch), codes[0])
        none = (letters == 0) | (bits.shape[1] == 0)
        if bits.shape[1]:
            best = np.argmin(bits, axis=1)
            low = bits[np.arange(n), best]
            others = np.where(np.arange(bits.shape[1])[None, :] == best[:, None], np.inf, bits).min(axis=1)
            score = np.where(np.isfinite(others), 1 - low / np.maximum(others, 1e-9), 1.0)
            names = [UNKNOWN if x else m.languages[k] for x, k in zip(none, best)]
        else:
            low, score, names = np.zeros(n), np.zeros(n), [UNKNOWN] * n
        return [pa.array(names, pa.string()), pa.array(np.where(none, 0.0, np.clip(score, 0, 1))), pa.array(np.where(none, 0.0, low))]

    return beside(docs, {"lang_pred": "string", "score": "double", "bits_per_letter": "double"}, work, 1 << 20)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = predict(docs.select("doc_id", "text"), train(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_letter")
