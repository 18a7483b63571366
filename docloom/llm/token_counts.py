"""Token counts by a compiled finite-state transducer.

A sentencepiece BPE model is compiled, state by state as texts ask for it, into a deterministic transducer over
characters. A state holds what the encoding of any continuation can still depend on: the longest text suffix that
begins some piece, the last token of the encoding at every cut inside that suffix, and the token counts there
relative to now. A transition carries the number of tokens that it adds to the encoding so far (negative where a
merge takes tokens back). Texts are cut into chunks of equal length; each chunk's map from entry state to (exit state,
tokens) is computed on its own: a run of spaces makes the machine forget what came before, so that all after a chunk's
first run is a constant and only the characters before it wait for the entry state. Maps compose to such maps by a
pairwise prefix scan.

Nulls and empty texts have no tokens. Nothing is cut or sampled. Kept states and segments are bounded (``MAX_STATES``,
``MAX_SEGMENTS``): beyond that a worker starts anew, which changes no count.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = 16_384
MAX_STATES = 250_000
MAX_SEGMENTS = 500_000


class Pieces:
    """The model's vocabulary, and plain BPE on short strings to compile from."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.score):
            raise ValueError("pieces with an inner space mark are not supported")
        if not {c for p in self.score for c in p} <= self.score.keys():
            raise ValueError("every character of a piece must be a piece")
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p))}
        self.joined: dict[tuple[str, str], bool] = {}
        # the tokens of runs of spaces repeat with the longest piece that is one; looked at over five of its lengths
        self.period = max((len(p) for p in self.score if not p.strip(SPACE)), default=1)
        self.settled = 4 * self.period
        self.runs = [0]
        while len(self.runs) <= self.settled + self.period:
            self.runs.append(len(self.merge(SPACE * len(self.runs))))
        if any(self.runs[n] != self.runs[n - self.period] + 1 for n in range(self.settled - self.period + 1, len(self.runs))):
            raise ValueError("runs of spaces whose tokens do not repeat with their longest piece are not supported")
        self.whole: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE as defined: always the best-scored adjacent pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_token(self, piece: str) -> bool:
        """Whether the piece is what BPE makes of its own text."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = piece in self.score and len(self.merge(piece)) == 1
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        known = self.joined.get((left, right))
        if known is None:
            known = self.joined[left, right] = self.merge(left + right) == [left, right]
        return known

    def run_tokens(self, n: int) -> int:
        """Tokens of a run of n spaces; runs repeat with the longest run piece."""
        more = max(0, -(-(n - self.settled) // self.period))
        return more + self.runs[n - self.period * more]


class State(dict):
    """character -> (next state, tokens added); filled on first use."""

    __slots__ = ("cuts", "machine", "rel", "run", "tail")

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.step(self, char)
        return step


class Segments(dict):
    """word -> tokens that it and the single space before it add; the space makes the entry state irrelevant."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.run(self.machine.blank, SPACE + word)[1]
        if len(word) <= 32:
            if len(self) >= MAX_SEGMENTS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    def __init__(self, pieces: Pieces):
        self.pieces, self.states, self.segments = pieces, {}, Segments(self)
        self.blank = self.state("", (None,), (0,), 0)

    @staticmethod
    def run(state: State, text: str) -> tuple[State, int]:
        n = 0
        for char in text:
            state, added = state[char]
            n += added
        return state, n

    def state(self, tail: str, cuts: tuple, rel: tuple, run: int) -> State:
        key = (tail, cuts, rel, run)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.tail, found.cuts, found.rel, found.run, found.machine = tail, cuts, rel, run, self
        return found

    def step(self, s: State, char: str) -> tuple[State, int]:
        p = self.pieces
        if char in (" ", SPACE):
            run = s.run + 1 if s.run < p.settled else p.settled - p.period + 1  # a run's count repeats
            now, before = p.run_tokens(run), p.run_tokens(run - 1)
            return self.state(SPACE, (None, SPACE), (before - now, 0), run), now - before if s.run < p.settled else p.run_tokens(p.settled + 1) - p.run_tokens(p.settled)
        if char not in p.score:
            return self.blank, len(char.encode("utf-8", "surrogatepass"))
        tail = s.tail + char
        for j, left in enumerate(s.cuts):
            piece = tail[j:]
            if p.is_token(piece) and (left is None or p.apart(left, piece)):
                break
        added = s.rel[j] + 1
        cuts, rel = (*s.cuts, piece), (*(n - added for n in s.rel), 0)
        drop = next((k for k in range(len(tail)) if tail[k:] in p.prefixes), len(tail))
        return self.state(tail[drop:], cuts[drop:], rel[drop:], 0), added


class ChunkMap:
    """Entry state -> (exit state, tokens) of a span of text, computed without its left neighbour.

    Only ``head``, the characters before the span's first run of spaces, can depend on the entry state. What follows it
    is a constant: ``tokens`` more and the exit state ``exit``. A span without such a run is all head (``exit`` None).
    """

    __slots__ = ("exit", "head", "machine", "tokens")

    def __init__(self, machine: Transducer, head: str, exit_: State | None = None, tokens: int = 0):
        self.machine, self.head, self.exit, self.tokens = machine, head, exit_, tokens

    def __call__(self, entry: State) -> tuple[State, int]:
        state, n = self.machine.run(entry, self.head)
        return (state, n) if self.exit is None else (self.exit, n + self.tokens)


def chunk_map(chunk: str, machine: Transducer, before: str = "") -> ChunkMap:
    """The map of a chunk; ``before`` is the one character that precedes it, which tells whether a run of spaces goes on."""
    a = 0
    if before in (" ", SPACE):
        while a < len(chunk) and chunk[a] in (" ", SPACE):
            a += 1
    a = min((k for k in (chunk.find(" ", a), chunk.find(SPACE, a)) if k >= 0), default=-1)
    if a < 0:
        return ChunkMap(machine, chunk)
    rest = chunk[a:]
    if "  " in rest or SPACE in rest:
        return ChunkMap(machine, chunk[:a], *machine.run(machine.blank, rest))
    # single spaces cut the rest into words whose own maps are constant and kept from text to text
    words = rest[1:].split(" ")
    return ChunkMap(machine, chunk[:a], machine.run(machine.blank, SPACE + words[-1])[0], sum(map(machine.segments.__getitem__, words)))


def compose(first: ChunkMap, second: ChunkMap) -> ChunkMap:
    """The map of two neighbouring spans, again as head and constant; associative."""
    if first.exit is None:
        return ChunkMap(first.machine, first.head + second.head, second.exit, second.tokens)
    state, n = second(first.exit)
    return ChunkMap(first.machine, first.head, state, first.tokens + n)


def scan(maps: list[ChunkMap]) -> ChunkMap:
    """Composes neighbours pair by pair, in log2(n) rounds; the pairs of a round do not depend on each other."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def chunks(text: str, machine: Transducer, size: int = CHUNK) -> list[ChunkMap]:
    """The maps of equal stretches of the text, wherever words end."""
    return [chunk_map(text[a : a + size], machine, text[a - 1 : a]) for a in range(0, len(text), size)]


class Counter:
    def __init__(self, model_file: str):
        self.pieces = Pieces(model_file)
        self.machine = Transducer(self.pieces)

    def count(self, text: str | None, size: int = CHUNK) -> int:
        if not text:
            return 0
        if len(self.machine.states) > MAX_STATES:
            self.machine = Transducer(self.pieces)
        # the encoder puts one space before a text
        return scan(chunks(" " + text, self.machine, size))(self.machine.blank)[1]


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """One per worker process; the file is found where the worker runs."""
    import public_tokenizers

    return Counter(public_tokenizers.path(model))


def n_tokens(text: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Tokens of each whole text, without begin, end or other special tokens."""

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        c = counter(model)
        return pa.array([c.count(t.as_py()) for t in texts], pa.int64())

    return tokens(text)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (repeated rows repeat; other columns are left out).

    Null texts count as empty: 0 bytes, 0 tokens, not over the limit. A null id is carried through.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    rows = rows.select("doc_id", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col("__text"), model).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
