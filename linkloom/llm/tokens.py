"""Token counts at every prefix of a text, by dynamic programming over a piece vocabulary.

For byte-pair merging the encoding of a prefix ends with exactly one piece t that is compatible with
the last piece of the shorter prefix before it: two pieces are compatible when merging their joined
characters gives back the two. So ``count[i] = count[i - len(t)] + 1`` yields the exact count at
every prefix in one pass. Pieces never reach over the start of a word (white space run plus word),
which lets each distinct word be solved once and kept; a text's counts are its words' tables laid
end to end on the running total. Characters outside the vocabulary cost their UTF-8 bytes.

The stored differences between neighbouring prefixes answer later questions (count of any prefix,
longest prefix within a budget) without encoding again.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted alike, other columns stay
as they are. A single word of any length is solved in time proportional to its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Words kept in each Python worker.
KEPT_WORDS, LONGEST_KEPT = 700_000, 40


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _differences(counts: list[int]) -> bytes:
    """As signed bytes: a piece has at most 16 characters of at most 4 bytes."""
    return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])  # noqa: B905


class PrefixCounter(dict):
    """Maps a word (without its first word mark) to the counts at its prefixes, mark included."""

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        odd = (sp.is_control, sp.is_unused, sp.is_byte, sp.is_unknown)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not any(f(i) for f in odd)}
        self.longest = max(map(len, self.score))
        self.fits: dict[str, dict[str, bool]] = {"": {}}
        self.known_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def table(self, word: str, same: int, counts: list[int], last: list[str]) -> None:
        """Continues the token counts of the prefixes of ``word``, of which the first ``same`` and the
        empty one are known; ``last`` holds the last piece of each prefix."""
        score, fits, longest = self.score, self.fits, self.longest
        for i in range(same + 1, len(word) + 1):
            for j in range(max(0, i - longest), i):
                t = word[j:i]
                if t in score:
                    if j:
                        own = fits.get(last[j])
                        if own is None:
                            own = fits[last[j]] = {}
                        fit = own.get(t)
                        if fit is None:
                            fit = own[t] = self.compatible(last[j], t)
                            self.known_pairs += 1
                        if not fit:
                            continue
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                c = word[i - 1]
                counts.append(counts[i - 1] + (1 if c in score else len(c.encode("utf-8", "surrogatepass"))))
                last.append(c)
        if self.known_pairs > 1_000_000:
            self.fits, self.known_pairs = {"": {}}, 0

    def prepare(self, texts: list[str]) -> None:
        """Solves all new words of a batch in alphabetical order: each starts where it parts from the
        one before it."""
        new = set()
        for text in texts:
            new.update(text.split(" "))
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
        counts, last, before = [0], [""], ""
        for word in sorted(w for w in new if w not in self and len(w) <= LONGEST_KEPT and SPACE not in w):
            marked, same = SPACE + word, 0
            for a, b in zip(marked, before):  # noqa: B905
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self.table(marked, same, counts, last)
            before = marked
            self[word] = _differences(counts)

    def __missing__(self, word: str) -> bytes:
        counts = [0]
        self.table(SPACE + word, 0, counts, [""])
        found = _differences(counts)
        if len(word) <= LONGEST_KEPT and len(self) < KEPT_WORDS:
            self[word] = found
        return found

    def deltas(self, text: str) -> bytes:
        """Difference of the token counts of neighbouring prefixes, a signed byte for each character."""
        if not text:
            return b""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            words = [m[1:] for m in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        found = b"".join(map(self.__getitem__, words))
        # The mark before the first word is no character of the text: its token belongs to the first one.
        first = int.from_bytes(found[:1], signed=True) + int.from_bytes(found[1:2], signed=True)
        return first.to_bytes(1, signed=True) + found[2:]


_counters: dict[str, PrefixCounter] = {}


def _counter(model: str) -> PrefixCounter:
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def prefix_counts(text: Column | str, model: str, budget: int = 4096) -> Column:
    """Struct of ``n_tokens``, ``chars_within`` (longest prefix of at most ``budget`` tokens) and
    ``deltas`` (the stored prefix counts) for a text column."""

    @F.arrow_udf("struct<n_tokens:long,chars_within:long,deltas:binary>")
    def counted(array: pa.Array) -> pa.Array:
        counter = _counter(model)
        totals, within, stored = [], [], []
        texts = [t or "" for t in array.to_pylist()]
        counter.prepare(texts)
        for text in texts:
            d = counter.deltas(text)
            counts = np.cumsum(np.frombuffer(d, np.int8), dtype=np.int64)
            totals.append(int(counts[-1]) if len(counts) else 0)
            within.append(longest_within(counts, budget))
            stored.append(d)
        arrays = [pa.array(totals, pa.int64()), pa.array(within, pa.int64()), pa.array(stored, pa.binary())]
        return pa.StructArray.from_arrays(arrays, ["n_tokens", "chars_within", "deltas"])

    return counted(F.col(text) if isinstance(text, str) else text)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens; counts need not be monotonic."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def tokens_at(deltas: Column | str, chars: Column | str) -> Column:
    """Tokens of the first ``chars`` characters, from the stored counts alone."""

    @F.arrow_udf("long")
    def looked_up(stored: pa.Array, wanted: pa.Array) -> pa.Array:
        wanted = pc.fill_null(wanted, 0).to_pylist()
        sums = [int(np.frombuffer(d or b"", np.int8)[: max(0, n)].sum(dtype=np.int64)) for d, n in zip(stored.to_pylist(), wanted, strict=True)]
        return pa.array(sums, pa.int64())

    return looked_up(*(F.col(c) if isinstance(c, str) else c for c in (deltas, chars)))


def chars_within(deltas: Column | str, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored counts alone."""

    @F.arrow_udf("long")
    def cut(stored: pa.Array) -> pa.Array:
        counts = (np.cumsum(np.frombuffer(d or b"", np.int8), dtype=np.int64) for d in stored.to_pylist())
        return pa.array([longest_within(c, budget) for c in counts], pa.int64())

    return cut(F.col(deltas) if isinstance(deltas, str) else deltas)


def query(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """The registered query; row-local, no shuffle."""
    counted = prefix_counts("text", model or public_model(), limit)
    found = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted.alias("c"))
    return found.select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), F.col("c.chars_within").alias("chars_within_limit"))
