"""Sentence-piece encoding from prefix tables, and decoding.

An encoding is fixed by its adjacent pairs (see ``token_counts``), so each prefix of a text has
one possible last token: the token that ends there, whose pair with the last token of the
prefix before it is an encoding of itself. An automaton over the vocabulary finds the tokens
that end at each place, the pair test picks the one that is kept in the prefix table, and the
ids are read off the table backwards. Texts are first cut where no piece of the vocabulary can
lie across: before a run of spaces and around newlines. Units met before come from a bounded
table; new ones share one automaton run, and their prefix tables are filled in side by side.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import small

SPACE = "▁"
#: Units that a worker keeps in each of two generations: the older one goes when the newer is full.
KEPT_UNITS = 150_000
#: Longer units are encoded by themselves and are not kept.
KEPT_CHARS = 64
#: Slots for the outcomes of pair tests; a pair that comes to another's slot takes it over.
PAIR_SLOTS = 1 << 20
#: Entries of the automaton's table of moves, of two or four bytes, that a worker may hold.
MOST_MOVES = 1 << 26
#: Characters of texts that are encoded together.
SLICE_CHARS = 1_000_000
#: Texts that a normaliser, special symbols or another handling of spaces would change.
PROBES = ("ﬁ ① Ａ é 　x y", " a  b ", "\ta\r\n\nb\x00c​", "▁a▁▁b", "<s></s><unk><0x41>", "日本語😀𝒳", "")

_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encodes and decodes with the vocabulary and scores of a model file with byte fallback.

    A model that these rules don't cover (another algorithm, a normaliser, symbols of its own,
    pieces across spaces) is refused: the library's ids of many pieces and of the probes have to be met.
    """

    def __init__(self, model: str, kept: int = KEPT_UNITS):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.vocab_size()
        self.kept = kept
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        byte = [i for i in range(size) if sp.is_byte(i)]
        self.byte_id = {int(self.piece[i][3:-1], 16): i for i in byte}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        surface = [b""] * size
        for i in plain:
            surface[i] = self.piece[i].replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            surface[i] = bytes([value])
        self.surface_of = {b"%d" % i: s for i, s in enumerate(surface)}
        # A cut is safe only where no piece can lie across it.
        if len(self.byte_id) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and p != "\n") for p in self.score):
            raise ValueError("the vocabulary has no byte fallback, or pieces across spaces or newlines")
        # Tokens: pieces that are their own encoding, and characters that occur in them only.
        of_piece = {self.piece[i]: b"%d," % i for i in plain if self.merged(self.piece[i]) == [self.piece[i]]}
        joining = sorted(set("".join(t for t in of_piece if len(t) > 1)))
        self.token = [*(t for t in of_piece if len(t) > 1), *joining]
        self.decimal = [of_piece.get(t) or self.fallback(t) for t in self.token]
        self.alone = {t: of_piece[t] for t in of_piece if len(t) == 1}
        self.length = np.array([len(t) for t in self.token], np.int32)
        self.build_automaton(joining)
        self.pair = np.full(PAIR_SLOTS, -1, np.int64)  # of each slot: pair and outcome
        self.spaced = re.compile(r"\n[^ \n]*| +[^ \n]*")
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Symbols of the model's own have no merge score.
        checked = [*PROBES, *(t for k, t in enumerate(self.score) if k % 16 == 0 or self.score[t] >= 0)]
        for ids, own in zip(sp.encode(checked, num_threads=1), self.encode_texts(checked), strict=True):
            if own != b"".join([b"%d," % i for i in ids]):
                raise ValueError("the model does more than merge pieces by score")
        self.units.clear()

    def fallback(self, char: str) -> bytes:
        return b"".join([b"%d," % self.byte_id[b] for b in char.encode()])

    def build_automaton(self, joining: list[str]) -> None:
        """Transitions by (state, class of character), and each state's tokens, which are those that end there.

        Class 0 is of characters that no token of more than one has: they stand alone.
        """
        self.kinds = len(joining) + 1
        self.kind = np.zeros(sys.maxunicode + 1, np.int16)
        self.kind[[ord(c) for c in joining]] = np.arange(1, self.kinds)
        prefixes = sorted({t[:n] for t in self.token for n in range(len(t) + 1)}, key=lambda t: (len(t), t))
        if len(prefixes) * self.kinds > MOST_MOVES:
            raise ValueError("the vocabulary's automaton is too large")
        number, state_of = {t: k for k, t in enumerate(self.token)}, {t: k for k, t in enumerate(prefixes)}
        self.moves = np.zeros((len(prefixes), self.kinds), np.int32 if len(prefixes) > 1 << 16 else np.uint16)
        kids: list[list[tuple[int, int]]] = [[] for _ in prefixes]
        for k, t in enumerate(prefixes[1:], 1):
            kids[state_of[t[:-1]]].append((int(self.kind[ord(t[-1])]), k))
        suffix, ends = [0] * len(prefixes), []
        for k, t in enumerate(prefixes):  # shorter ones first, so the longest proper suffix is complete
            if k:
                self.moves[k] = self.moves[suffix[k]]
            ends.append(([number[t]] if t in number else []) + (ends[suffix[k]] if k else []))
            for c, kid in kids[k]:
                suffix[kid] = int(self.moves[k, c])
                self.moves[k, c] = kid
        self.n_ends = np.array([len(e) for e in ends])
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array(list(chain.from_iterable(ends)), np.int32)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of tokens are encodings of themselves."""
        key = left.astype(np.int64) * len(self.token) + right
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (PAIR_SLOTS - 1)
        known = self.pair[slot]
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            pairs, of = np.unique(key[new], return_inverse=True)
            found = np.array([2 * p + self.fits(*divmod(p, len(self.token))) for p in pairs.tolist()])
            known[new] = self.pair[slot[new]] = found[of]
        return (known & 1).astype(bool)

    def fits(self, left: int, right: int) -> bool:
        pair = [self.token[left], self.token[right]]
        return self.merged("".join(pair)) == pair

    def one_alone(self, char: str) -> bytes:
        return self.alone.get(char) or self.fallback(char)

    def encode_long(self, unit: str) -> bytes:
        """Decimal ids of one unit, each followed by a comma: its prefix table, read backwards.

        The table begins anew after each character that stands alone.
        """
        n, begin, state = len(unit), len(self.token), 0
        last, pairs, length = [-1] * (n + 1), {}, self.length
        last[0] = begin
        for end, kind in enumerate(self.kind[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist(), 1):
            state = self.moves.item(state, kind)
            if not kind:
                last[end] = begin
                continue
            first = self.first_end.item(state)
            for token in self.ends[first : first + self.n_ends.item(state)].tolist():
                before = last[end - length.item(token)]
                if before >= 0 and before != begin and (before, token) not in pairs:
                    pairs[before, token] = self.compatible(np.array([before]), np.array([token])).item()
                if before == begin or (before >= 0 and pairs[before, token]):
                    last[end] = token
                    break
        found, at = [], n
        while at:
            token = last[at]
            found.append(self.one_alone(unit[at - 1]) if token == begin else self.decimal[token])
            at -= 1 if token == begin else length.item(token)
        return b"".join(reversed(found))

    def encode_short(self, units: list[str]) -> list[bytes]:
        """As ``encode_long`` for many units at once, place by place; longer ones come first."""
        size = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, kind = np.cumsum(size) - size, self.kind[codes]
        n, begin, deepest = len(units), len(self.token), int(size.max(initial=0))
        last = np.full((deepest + 1) * n, -1, np.int32)  # by place, then unit
        last[:n] = begin
        state = np.zeros(n, np.int64)
        for place in range(1, deepest + 1):
            now = np.searchsorted(-size, -place, side="right")  # units that reach this place
            c = kind[start[:now] + (place - 1)]
            state = self.moves.ravel()[state[:now] * self.kinds + c].astype(np.int64)
            many = self.n_ends[state]
            row = np.repeat(np.arange(now), many)
            shift = np.cumsum(many) - many
            token = self.ends[np.arange(len(row)) + np.repeat(self.first_end[state] - shift, many)]
            before = last[(place - self.length[token]) * n + row]
            fits = before == begin
            asked = np.flatnonzero((before >= 0) & ~fits)
            fits[asked] = self.compatible(before[asked], token[asked])
            last[place * n + row[fits]] = token[fits]
            last[place * n + np.flatnonzero(c == 0)] = begin
        # Back from each unit's end, all units at once; a character that stands alone is noted as -1 - code.
        unit, at, parts = np.arange(n), size, []
        while len(unit := unit[at > 0]):
            at = at[at > 0]
            token = last[at * n + unit]
            alone = token == begin
            noted = token.astype(np.int64)
            noted[alone] = -1 - codes[start[unit[alone]] + at[alone] - 1].astype(np.int64)
            parts.append((unit, noted))
            at = at - np.where(alone, 1, self.length[np.where(alone, 0, token)])
        if not parts:
            return [b""] * n
        owner, noted = (np.concatenate(x[::-1]) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        decimal = self.decimal
        text = [decimal[t] if t >= 0 else self.one_alone(chr(-1 - t)) for t in noted[order].tolist()]
        cuts = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        return [b"".join(text[a:z]) for a, z in zip([0, *cuts], cuts, strict=False)]

    def cut(self, text: str) -> list[str]:
        """The text's units: words with the spaces before them, less one; or newlines with the word after them."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return [u if u[0] == "\n" else u[1:] for u in self.spaced.findall(" " + text.replace(SPACE, " "))]
        return text.replace("\n", " \n").split(" ")

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Decimal ids of units as ``cut`` gives them."""
        line = self.encode_long("\n")
        spoken = [u[1:] if u[:1] == "\n" else SPACE + u.replace(" ", SPACE) for u in units]
        order = sorted(range(len(units)), key=lambda k: -len(spoken[k]))
        short = next((k for k, u in enumerate(order) if len(spoken[u]) <= KEPT_CHARS), len(order))
        ids = [*(self.encode_long(spoken[k]) for k in order[:short]), *self.encode_short([spoken[k] for k in order[short:]])]
        found = [b""] * len(units)
        for k, own in zip(order, ids, strict=True):
            found[k] = line + own if units[k][:1] == "\n" else own
        return found

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Decimal ids of whole texts, each id followed by a comma."""
        cut = [self.cut(t) for t in texts]
        if len(self.units) > self.kept:
            self.older, self.units = self.units, {}
        known, older = self.units, self.older
        fresh = set().union(*cut).difference(known)
        known.update([(u, older[u]) for u in fresh if u in older])
        fresh = list(fresh.difference(older))
        known.update(zip(fresh, self.encode_units(fresh), strict=True))
        found = [b"".join([known[u] for u in units]) for units in cut]
        for u in fresh:
            if len(u) >= KEPT_CHARS:
                del known[u]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0].split(b",")[:-1]]

    def decode_text(self, ids: list[bytes]) -> str:
        """The text of decimal ids: pieces in order, without the space before the first."""
        surface = self.surface_of
        found = b"".join([surface[i] for i in ids])
        if ids and surface[ids[0]].startswith(b" "):
            found = found[1:]
        return found.decode("utf-8", "replace")


def codec(model: str) -> PieceCodec:
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def text_slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts that come to SLICE_CHARS characters at most, or of one longer text."""
    held, chars = [], 0
    for text in texts:
        if held and chars + len(text) > SLICE_CHARS:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def id_array(ids: list[bytes]) -> np.ndarray:
    """Numbers of decimal ids of any length."""
    return np.array(ids, "S").astype(np.int32) if ids else np.zeros(0, np.int32)


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded), one for each row of ``docs``.

    ``decoded`` is made from the ids alone. ``keep_ids=False`` and ``keep_text=False`` leave the last
    two columns out where they aren't wanted, so that they are never sent back from the workers. Null
    text counts as empty: no ids, and an empty text back. A map-only job: repeated rows and null
    ids need no care, other columns are ignored, and a long text needs memory in proportion to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(model))
        for batch in small(batches):
            counts, id_digests, text_digests, all_ids, texts = [], [], [], [], []
            for joined in chain.from_iterable(map(own.encode_texts, text_slices([t or "" for t in batch.column(1).to_pylist()]))):
                ids = joined.split(b",")[:-1]
                decoded = own.decode_text(ids)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(joined[:-1]).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(id_array(ids))
                if keep_text:
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
