"""Pieces of a public tokenizer vocabulary, and trie walks over sorted marked words.

The vocabulary's scores weight its pieces. A file whose scores are merge ranks (0, -1, -2, ..)
has no probabilities, so piece r counts 1 / (r + 2) under Zipf's law, and all weights are scaled
to sum to 1; scores of a unigram file are used as they are. White space is written as a blank
here. Characters without a piece are spelled in byte pieces.

The language model starts from these weights and re-estimates them by expected counts
(`Walker.expected`, `Pieces.estimated`); the coder uses them as they are.

Words are sorted, which lays their trie out in depth-first order: a word keeps the state of
every node that it shares with the word before, and only its own nodes are computed. A state
holds the node's best (or summed) score and the pieces that are still open there. A word of
over LONG characters shares nothing: its scores lie in arrays, about 12 bytes a character, and
only the pieces open at the present character are held.
"""

from __future__ import annotations

import math
import os
from array import array
from collections.abc import Iterator, Sequence

DEFAULT_MODEL = os.environ.get("MARLSTONE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


#: Characters of a word that is walked by itself.
LONG = 256
#: Words' worth of the vocabulary's own weights that estimated ones are mixed with.
PRIOR = 1000.0


class Pieces:
    def __init__(self, texts: list[bytes], scores: list[float], bytes_at: list[int], ordinary: list[int], end: float):
        """texts: each id's bytes; scores: natural logarithms; bytes_at: the ids of bytes 0 to 255; end: the score of a text's end."""
        self.end = end
        self.texts, self.scores, self.bytes_at, self.ordinary = texts, scores, bytes_at, ordinary

    def estimated(self, counts: Sequence[float], ends: int) -> Pieces:
        """The same pieces weighted by expected counts and the number of text ends, with PRIOR of the own weights."""
        total = sum(counts) + ends + PRIOR
        scores = [math.log((n + PRIOR * math.exp(s)) / total) for n, s in zip(counts, self.scores, strict=True)]
        return Pieces(self.texts, scores, self.bytes_at, self.ordinary, math.log((ends + PRIOR * math.exp(self.end)) / total))

    def trie(self) -> dict:
        """Nested characters; a node's "" holds (score, id)."""
        top: dict = {}
        for i in self.ordinary:
            node = top
            for c in self.texts[i].decode():
                node = node.setdefault(c, {})
            node[""] = (self.scores[i], i)
        return top


def load(model: str = DEFAULT_MODEL) -> Pieces:
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=model)
    n = held.get_piece_size()
    raw = [held.get_score(i) for i in range(n)]
    ordinary = [i for i in range(n) if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i))]
    ranked = all(raw[i] <= 0 and raw[i] == int(raw[i]) for i in ordinary)
    texts = [b""] * n
    for i in ordinary:
        text = held.id_to_piece(i).replace("▁", " ")
        if "\n" in text or " " in text.lstrip(" "):
            raise ValueError("pieces may not cross words")
        texts[i] = text.encode()
    if ranked:
        weight = {i: 1 / (min(-raw[i], n) + 2) for i in ordinary}
        spelled = 1 / (2 * n + 2)
        total = sum(weight.values()) + 256 * spelled + 1 / 2  # the last for the end of a text
        scores = [math.log(weight[i] / total) if i in weight else math.log(spelled / total) for i in range(n)]
        end = math.log(1 / 2 / total)
    else:
        worst = end = min(raw[i] for i in ordinary) - 10
        known = set(ordinary)
        scores = [raw[i] if i in known else worst for i in range(n)]
    bytes_at = [held.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    for b, i in enumerate(bytes_at):
        texts[i] = bytes([b])
    return Pieces(texts, scores, bytes_at, ordinary, end)


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Walker:
    """Forward scores along the trie of sorted words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.trie = pieces, pieces.trie()
        self.spelled: dict[str, float] = {}

    def _byte_score(self, c: str) -> float:
        found = self.spelled.get(c)
        if found is None:
            found = self.spelled[c] = sum(self.pieces.scores[self.pieces.bytes_at[b]] for b in c.encode())
        return found

    def _arcs(self, open_: list, i: int, c: str) -> tuple[list, list[tuple[int, float, int]]]:
        """The pieces open after character i, and (start, score, id) of those that end with it; id -1 is bytes."""
        now, ends = [], []
        node = self.trie.get(c)
        if node is not None:
            now.append((i, node))
        for start, held in open_:
            held = held.get(c)
            if held is not None:
                now.append((start, held))
        for start, held in now:
            end = held.get("")
            if end is not None:
                ends.append((start, *end))
        if node is None or "" not in node:
            ends.insert(0, (i, self._byte_score(c), -1))
        return now, ends

    def _long_ids(self, word: str) -> array:
        """The ids of a long word's best segmentation."""
        best, back, open_ = array("d", [0.0]), array("i", [0]), []
        sizes: dict[int, int] = {}
        for i, c in enumerate(word):
            open_, ends = self._arcs(open_, i, c)
            score, link = -math.inf, 0
            for start, s, piece in ends:
                if best[start] + s > score:
                    score, link = best[start] + s, piece
                    sizes.setdefault(piece, i + 1 - start)
            best.append(score)
            back.append(link)
        ids, i = array("i"), len(word)
        while i:
            piece = back[i]
            if piece >= 0:
                ids.append(piece)
                i -= sizes[piece]
            else:
                ids.extend(self.pieces.bytes_at[b] for b in reversed(word[i - 1].encode()))
                i -= 1
        ids.reverse()
        return ids

    def _long_totals(self, word: str) -> array:
        """The log probability of every beginning of a long word."""
        total, open_ = array("d", [0.0]), []
        for i, c in enumerate(word):
            open_, ends = self._arcs(open_, i, c)
            parts = [total[start] + s for start, s, _ in ends]
            most = max(parts)
            total.append(most + math.log(sum([math.exp(p - most) for p in parts])))
        return total

    def segment(self, words: list[str]) -> Iterator[Sequence[int]]:
        """The ids of each sorted word's best segmentation; the shorter last piece wins a tie."""
        trie, bytes_at = self.trie, self.pieces.bytes_at
        best, back, opened = [0.0], [(0, -1)], [()]
        before = ""
        for word in words:
            if len(word) > LONG:
                yield self._long_ids(word)
                continue
            keep = _shared(before, word)
            del best[keep + 1 :], back[keep + 1 :], opened[keep + 1 :]
            for i in range(keep, len(word)):
                c, at, score, link = word[i], best[i], -math.inf, None
                now = []
                node = trie.get(c)
                if node is not None:
                    now.append((i, node))
                    end = node.get("")
                    if end is not None:
                        score, link = at + end[0], (i, end[1])
                if link is None:
                    score, link = at + self._byte_score(c), (i, -1)
                for start, node in opened[i]:
                    node = node.get(c)
                    if node is not None:
                        now.append((start, node))
                        end = node.get("")
                        if end is not None and best[start] + end[0] > score:
                            score, link = best[start] + end[0], (start, end[1])
                best.append(score)
                back.append(link)
                opened.append(now)
            ids: list[int] = []
            i = len(word)
            while i:
                start, piece = back[i]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [bytes_at[b] for b in reversed(word[start:i].encode())]
                i = start
            ids.reverse()
            yield ids
            before = word

    def likelihood(self, words: list[str]) -> Iterator[float]:
        """Natural logarithm of each sorted word's probability, summed over all segmentations."""
        return (total[-1] for total in self._totals(words))

    def expected(self, words: list[str], counts: Sequence[int], into: list[float]) -> None:
        """Add to `into` how often each piece is expected in sorted words that occur `counts` times.

        What passes each place goes back to the pieces that end there in proportion to what they
        brought to its sum; going back by beginnings, every place is complete when it is reached.
        """
        trie, exp, bytes_at = self.trie, math.exp, self.pieces.bytes_at
        for word, total, n in zip(words, self._totals(words), counts, strict=True):
            size = len(word)
            passing = array("d", bytes(8 * size + 8))
            passing[size] = n
            for i in range(size - 1, -1, -1):
                node, through, whole = trie, 0.0, False
                for e in range(i, size):
                    node = node.get(word[e])
                    if node is None:
                        break
                    end = node.get("")
                    if end is not None:
                        whole |= e == i
                        if passing[e + 1]:
                            share = passing[e + 1] * exp(total[i] + end[0] - total[e + 1])
                            into[end[1]] += share
                            through += share
                if not whole and passing[i + 1]:
                    share = passing[i + 1] * exp(total[i] + self._byte_score(word[i]) - total[i + 1])
                    for b in word[i].encode():
                        into[bytes_at[b]] += share
                    through += share
                passing[i] = through

    def _totals(self, words: list[str]) -> Iterator[Sequence[float]]:
        """The log probabilities of every beginning of each sorted word; the next step may change them."""
        trie, exp, log = self.trie, math.exp, math.log
        total, opened = [0.0], [()]
        before = ""
        for word in words:
            if len(word) > LONG:
                yield self._long_totals(word)
                continue
            keep = _shared(before, word)
            del total[keep + 1 :], opened[keep + 1 :]
            for i in range(keep, len(word)):
                c, parts, now = word[i], [], []
                node = trie.get(c)
                if node is not None:
                    now.append((i, node))
                    end = node.get("")
                    if end is not None:
                        parts.append(total[i] + end[0])
                if not parts:
                    parts.append(total[i] + self._byte_score(c))
                for start, node in opened[i]:
                    node = node.get(c)
                    if node is not None:
                        now.append((start, node))
                        end = node.get("")
                        if end is not None:
                            parts.append(total[start] + end[0])
                if len(parts) == 1:
                    total.append(parts[0])
                else:
                    most = max(parts)
                    total.append(most + log(sum([exp(p - most) for p in parts])))
                opened.append(now)
            yield total
            before = word
