"""Token counts by dynamic programming over the matches of a vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character. What the dynamic programming carries
depends on the model:

* Counter (unigram models): the best score and its number of pieces, nothing else. Ties go as in the tokenizer: of equal
  scores the path found first stays, and starts are tried from left to right. A character that no piece covers alone costs
  the least score less UNKNOWN_PENALTY; it counts as its UTF-8 bytes if the vocabulary has byte pieces, otherwise runs of
  such characters count as one.
* MergeCounter (byte-pair models in piece files): the last piece and the number of pieces. A sequence of pieces is the
  tokenizer's if and only if each piece, and each neighbouring two, tokenize to themselves; so every prefix has one last piece,
  the one that fits the last piece of the prefix before it. The score of a piece is the time of its merge: higher scores
  merge first, of equal ones the leftmost.

Texts are cut before each run of spaces, which pieces never cross, so words are counted independently and the counts of words
seen before are reused (at most twice CACHE_WORDS of them are held, and CACHE_PAIRS pairs of pieces). Both counts of a word are
held together.

Defined results for odd input: a null or empty text has 0 tokens; ids may be null or repeated; further columns are ignored;
texts of any length are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
CACHE_PAIRS = 1_000_000
LONGEST_CACHED = 48
SPACE = "▁"


def _model(model_path: str):
    import sentencepiece.sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def pieces_from(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    return [(p.piece, p.score) for p in _model(model_path).pieces]


def merges_from(model_path: str) -> list[tuple[str, float]]:
    """Pieces that merges make (or that are single characters) and their scores, of a byte-pair model file.

    Refused: models of another type, with a normalisation that changes texts, or whose pieces cross words.
    """
    model = _model(model_path)
    rules = model.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{model_path}: not a byte-pair model with byte fallback and unchanged texts")
    found = [(p.piece, p.score) for p in model.pieces if p.type == p.NORMAL]
    if any(SPACE in piece.lstrip(SPACE) for piece, _ in found):
        raise ValueError(f"{model_path}: pieces cross words")
    return found


class _Cached(dict):
    """Counts of words, made when first asked for. When it is full, its words become the older ones, of which those that come again
    are taken over."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.make(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts of pieces on the best path."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {piece for piece, _ in pieces}
        self.single = frozenset(piece for piece in names if len(piece) == 1)
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache = _Cached(lambda word: self.covered(SPACE + word))

    def covered(self, word: str) -> int:
        """Number of pieces of a word's best path; short where each of its characters is a piece."""
        if not self.single.issuperset(word):
            return self.best(word)[1]
        n = len(word)
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        # Matches come by their ends, of one end the longest first.
        for end, (size, value) in self.automaton.iter(word):
            total = score[end + 1 - size] + value
            if total > score[end + 1]:
                score[end + 1], count[end + 1] = total, count[end + 1 - size] + 1
        return count[n]

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of a word's best path."""
        n = len(word)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for end in range(n):
            top, single = None, False
            for size, value in sorted(ends[end], reverse=True):
                single |= size == 1
                start = end + 1 - size
                total = score[start] + value
                if top is None or total > top:
                    top, pieces, unknown = total, count[start] + 1, False
            if not single:
                total = score[end] + self.unknown
                if top is None or total > top:
                    top, unknown = total, True
                    pieces = count[end] + (len(word[end].encode("utf-8", "surrogatepass")) if self.bytes else not loose[end])
            score[end + 1], count[end + 1], loose[end + 1] = top, int(pieces), unknown
        return score[n], count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        return sum(map(self.cache.__getitem__, words))


class MergeCounter:
    """Counts of the pieces that merging neighbours by score leaves."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        self.single = frozenset(piece for piece in self.score if len(piece) == 1)
        self.automaton = ahocorasick.Automaton()
        #: Of each piece that tokenizes to itself: its merges as (score, symbol at its right end, symbol at its left end).
        self.right: list[tuple[str, list[tuple[float, str]]]] = []
        self.left: list[tuple[str, list[tuple[float, str]]]] = []
        for piece in self.score:
            steps = self.merges(piece)
            if steps is not None:
                self.automaton.add_word(piece, (len(piece), len(self.right)))
                self.right.append((piece[-1], [(score, right) for score, right, _ in steps]))
                self.left.append((piece[0], [(score, left) for score, _, left in steps]))
        self.automaton.make_automaton()
        self.size = len(self.right)
        self.pairs = _Pairs(self)
        self.cache = _Cached(self.pieces)

    def merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """Merges that make a piece out of its characters, a neighbouring pair of highest score first, the leftmost of equals:
        (score, symbol at the right end after it, at the left end). None if they leave more than one symbol."""
        parts, steps = list(piece), []
        while len(parts) > 1:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found:
                return None
            score, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((-score, parts[-1], parts[0]))
        return steps if parts[0] in self.score else None

    def parted(self, left: int, right: int) -> bool:
        """Do two neighbouring pieces stay two? Their merges go on in order of score, until one would join the symbols at the border."""
        a, mine = self.right[left]
        b, theirs = self.left[right]
        i = j = 0
        least = float("-inf")
        while True:
            next_left = mine[i][0] if i < len(mine) else least
            next_right = theirs[j][0] if j < len(theirs) else least
            # The merge at the border is right of those in the left piece, and left of those in the right one.
            across = self.score.get(a + b)
            if across is not None and across > next_left and across >= next_right:
                return False
            if i < len(mine) and next_left >= next_right:
                a, i = mine[i][1], i + 1
            elif j < len(theirs):
                b, j = theirs[j][1], j + 1
            else:
                return True

    def pieces(self, word: str) -> int:
        """Number of pieces of a word."""
        if not self.single.issuperset(word):
            # No merge has a character that is no piece: it stands as its bytes, and parts what is before it from what follows.
            total, run = 0, []
            for ch in word:
                if ch in self.single:
                    run.append(ch)
                else:
                    total += self.pieces("".join(run)) + len(ch.encode("utf-8", "surrogatepass"))
                    run.clear()
            return total + self.pieces("".join(run))
        count, last = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        pairs, size = self.pairs, self.size
        # Matches come by their ends; only one piece can end the tokens of a prefix.
        for end, (width, piece) in self.automaton.iter(word):
            if last[end + 1] < 0:
                before = last[end + 1 - width]
                if end + 1 == width or (before >= 0 and pairs[before * size + piece]):
                    count[end + 1], last[end + 1] = count[end + 1 - width] + 1, piece
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.cache.__getitem__, _WORD.findall(SPACE + text.replace(" ", SPACE))))


class _Pairs(dict):
    """Which pieces (by number, as one number) stay two, found when first asked for."""

    def __init__(self, counter: MergeCounter):
        self.counter = counter

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        self[pair] = known = self.counter.parted(*divmod(pair, self.counter.size))
        return known


class BothCounter:
    """Counts of a byte-pair model and of its scores as a unigram model, in one pass over a text."""

    def __init__(self, merges: MergeCounter, unigram: Counter):
        self.merges, self.unigram = merges, unigram
        self.cache = _Cached(self.both)
        # A line break that is in no piece parts the words beside it in both models.
        self.breaks = unigram.bytes and "\n" not in merges.single | unigram.single
        self.find = (_WORD_OR_BREAK if self.breaks else _WORD).findall
        self.space = unigram.covered(SPACE)
        self.single = merges.single & unigram.single
        numbers = {piece: number for piece, (_, number) in merges.automaton.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, (size, score) in unigram.automaton.items():
            self.automaton.add_word(piece, (size, score, numbers.pop(piece, -1)))
        # Pieces of the one model alone would need passes of their own.
        self.shared = not numbers
        self.automaton.make_automaton()

    def both(self, word: str) -> int:
        """The two counts of a word with the spaces before it, the second one above 32 bits."""
        if self.shared and word[1:2] != SPACE and self.single.issuperset(word):
            return self._at_once(word)
        core = word.lstrip(SPACE)
        spaces = len(word) - len(core)
        if core and spaces:
            second = (spaces - 1) * self.space + self.unigram.covered(SPACE + core)
        else:
            second = spaces * self.space + (self.unigram.covered(core) if core else 0)
        return self.merges.pieces(word) + (second << 32)

    def _at_once(self, word: str) -> int:
        """The same for a word of at most one space whose characters are all pieces, from one run over its matches."""
        n = len(word)
        score, best = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        pairs, many = self.merges.pairs, self.merges.size
        for end, (size, value, number) in self.automaton.iter(word):
            end += 1
            start = end - size
            total = score[start] + value
            if total > score[end]:
                score[end], best[end] = total, best[start] + 1
            if number >= 0 > last[end]:
                before = last[start]
                if not start or (before >= 0 and pairs[before * many + number]):
                    count[end], last[end] = count[start] + 1, number
        return count[n] + (best[n] << 32)

    def count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        marked = SPACE + text.replace(" ", SPACE)
        total = sum(map(self.cache.__getitem__, self.find(marked)))
        # Of a space that begins the text, the second model makes no more of one.
        return total & 0xFFFFFFFF, (total >> 32) - (self.space if marked[1] == SPACE else 0)


_WORD_OR_BREAK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


_held: dict[tuple, Counter | BothCounter] = {}


def _counter(vocabularies) -> Counter | BothCounter:
    """This worker's counter: built once, its cache kept from task to task."""
    key = tuple((kind, hash(tuple(pieces))) for kind, pieces in vocabularies.value)
    if key not in _held:
        _held.clear()
        made = [(Counter if kind == "unigram" else MergeCounter)(pieces) for kind, pieces in vocabularies.value]
        _held[key] = made[0] if len(made) == 1 else BothCounter(*made)
    return _held[key]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", merges: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_chars) for each row of docs. No shuffle; the vocabulary, of fixed size, is broadcast.

    n_tokens takes the file's pieces and scores as a unigram model. With merges, the file is a byte-pair model: n_tokens is its own
    tokenizer's count, and a column n_unigram has the count over the scores.
    """
    vocabularies = [("unigram", pieces_from(model_path))]
    names = ["doc_id", "n_tokens", "n_chars"]
    if merges:
        vocabularies.insert(0, ("merges", merges_from(model_path)))
        names.append("n_unigram")
    held = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held)
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(1)]
            found = [counter.count(text) for text in texts]
            sizes = [len(text) for text in texts]
            columns = [[x for x, _ in found], sizes, [y for _, y in found]] if merges else [found, sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, ", ".join(f"{n} long" for n in names))
