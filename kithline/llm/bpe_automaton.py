"""BPE encoding and decoding by a deterministic tokenization automaton.

The merge list is compiled into an automaton over token labels by successive
merge gadgets. It starts with one state that loops on every base symbol. The
merge ``(u, v) -> w`` copies the state that arcs labelled ``u`` lead to, takes the
arc ``v`` out of the copy, lets all arcs ``u`` lead to the copy, and adds an arc
``w`` wherever ``u`` then ``v`` could be read; ``w`` leads where ``v`` led. After the
last merge the automaton accepts exactly the segmentations that BPE produces, one
for each string.

All arcs with one label lead to one state. Most of the states are only steps of
the construction; the ones that labels lead to at the end are kept (11,612 for
49,406 labels). A state lacks few of all arcs: taking out ``v`` at time k takes out
``v`` itself and all labels that begin with a merge of ``v`` made from k on. Labels are
numbered so that these are one range (depth first by left parts, in the order of
merges), and a state is the sorted edges of its missing ranges in one shared array.

A word is read from left to right once, symbol by symbol. Every prefix has one
accepted path, so one label and with it one state is known after each symbol: the
longest label that ends there (table of the label trie with failure arcs) for
which the state before it has an arc. The labels are then read back from the
end. Nothing is stepped back and tried again. Decoding emits arc labels.

Edge cases: null text counts as empty (no tokens, hash of the empty string);
texts of any length are done word by word; repeated rows give repeated results;
an empty table gives an empty result; extra columns are ignored; doc_id may have
any type.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kithline.llm.common import arrow_map

#: The words kept with their encodings in a task, once they have come twice: this many newer ones and as many older ones. Bits that tell whether a word has come.
WORD_TABLE, SEEN_BITS = 60_000, 22
#: Transitions by failure arcs, and arcs of states, that a task keeps resolved.
STEP_TABLE, ARC_TABLE = 200_000, 200_000
_END = "\0"
#: Characters below this, but for one, are classed and folded alike by Python and the tokenizer library.
_PLAIN_BELOW = "԰"
_CONTEXTUAL = "Σ"


def plain_classes() -> dict[str, str]:
    """Ranges of letters, numbers and white space among the plain characters, as bodies of bracket expressions."""
    kinds: dict[str, list[list[int]]] = {"L": [], "N": [], "Z": []}
    for cp in range(ord(_PLAIN_BELOW)):
        kind = "Z" if cp in (0x85, 0xA0) or 9 <= cp <= 13 or cp == 32 else unicodedata.category(chr(cp))[0]
        if kind in kinds:
            ranges = kinds[kind]
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return {k: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in v) for k, v in kinds.items()}


def plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of plain characters only, where the standard library's engine can run it."""
    kinds = plain_classes()
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{kinds['Z']}{kinds['L']}{kinds['N']}]")
    for k in "LN":
        pattern = pattern.replace(f"[\\p{{{k}}}]", f"[{kinds[k]}]").replace(f"\\p{{{k}}}", f"[{kinds[k]}]")
    return re.compile(pattern.replace("\\s", f"[{kinds['Z']}]").replace("\\S", f"[^{kinds['Z']}]"))


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class TokenAutomaton:
    """The compiled merges: states as missing ranges of labels, labels as a trie with failure arcs, all in arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_suffix: str = ""):
        self.suffix = end_suffix
        marked = (lambda s: s[: -len(end_suffix)] + _END if s.endswith(end_suffix) else s) if end_suffix else (lambda s: s)
        self.text: dict[int, str] = {i: s for s, i in vocab.items()}
        ids = {marked(s): i for s, i in vocab.items()}
        made = self._gadgets(ids, [(marked(u), marked(v)) for u, v in merges])
        self._compile(ids, *made)

    def _gadgets(self, ids: dict[str, int], merges: list[tuple[str, str]]) -> tuple[dict, dict, list]:
        """The construction: parts of each label that merges make, the state each label leads to, and by state its parent and what was taken out."""
        made: dict[int, tuple[int, int, int]] = {}  # label: left part, right part, time
        pairs: dict[tuple[int, int], int] = {}
        leads: dict[int, int] = {}
        states: list[tuple[int, int, int]] = [(-1, -1, -1)]  # parent, label taken out, time

        def edge(t: int, side: int, now: int) -> list[tuple[int, int]]:
            """The labels on one edge of t, each with the time at which a merge closed it."""
            out, closes = [], now
            while t in made:
                out.append((t, closes))
                t, closes = made[t][side], made[t][2]
            return [*out, (t, closes)]

        for k, (left, right) in enumerate(merges):
            u, v, w = ids[left], ids[right], ids[left + right]
            if w in made or any(made[x][2] >= k for x in (u, v) if x in made):
                raise ValueError("merges must make each symbol once, before it is used")
            # a pair that earlier gadgets keep apart is never read, so its gadget changes nothing
            if any(pairs.get((x, y), k) < min(cx, cy + 1) for x, cx in edge(u, 1, k) for y, cy in edge(v, 0, k)):
                continue
            made[w], pairs[u, v] = (u, v, k), k
            leads[w] = leads.get(v, 0)
            states.append((leads.get(u, 0), v, k))
            leads[u] = len(states) - 1
        return made, leads, states

    def _compile(self, ids: dict[str, int], made: dict, leads: dict, states: list) -> None:
        base = [t for s, t in ids.items() if t not in made and (len(s) == 1 or (len(s) == 2 and s[1] == _END and self.suffix))]
        kids: dict[int, list[int]] = {}
        for w, (u, _, _) in made.items():  # in the order of merges
            kids.setdefault(u, []).append(w)
        number, last, todo = {}, {}, [(t, False) for t in reversed(base)]
        while todo:
            t, done = todo.pop()
            if done:
                last[t] = len(number)
            else:
                number[t] = len(number)
                todo.append((t, True))
                todo.extend((w, False) for w in reversed(kids.get(t, ())))
        self.ids = array("i", number)
        self.number = number
        kept = {s: i for i, s in enumerate(dict.fromkeys(leads.get(t, 0) for t in self.ids))}
        self.leads = [kept[leads.get(t, 0)] for t in self.ids]
        edges, heads = array("i"), array("i", [0])
        for s in kept:
            out: list[tuple[int, int]] = []
            while s:
                s, v, k = states[s]
                out.append((number[v], number[v] + 1))
                later = bisect_left(kids.get(v, ()), k, key=lambda w: made[w][2])
                if later < len(kids.get(v, ())):
                    out.append((number[kids[v][later]], last[v]))
            end = -1
            for a, b in sorted(out):  # overlapping and touching ranges become one
                if a > end:
                    edges.extend((a, b))
                    end = b
                elif b > end:
                    edges[-1] = end = b
            heads.append(len(edges))
        self.edges, self.heads = edges, heads
        self._trie({t: s for s, t in ids.items() if t in number})

    def _trie(self, spelled: dict[int, str]) -> None:
        symbols = lambda s: [*s[:-2], s[-2:]] if self.suffix and s.endswith(_END) else s
        self.symbol = {s: i for i, s in enumerate(dict.fromkeys(c for s in spelled.values() for c in symbols(s)))}
        self.width = len(self.symbol)
        goto: dict[int, int] = {}
        by_depth: list[list[tuple[int, int, int]]] = []
        at_label, ends = array("i", bytes(4 * len(spelled))), {}
        self.size = array("i", bytes(4 * len(spelled)))
        for t, s in spelled.items():
            node = 0
            for depth, c in enumerate(symbols(s)):
                key = node * self.width + self.symbol[c]
                if key not in goto:
                    goto[key] = len(goto) + 1
                    if depth == len(by_depth):
                        by_depth.append([])
                    by_depth[depth].append((goto[key], node, self.symbol[c]))
                node = goto[key]
            ends[node] = self.number[t]
            at_label[self.number[t]] = node
            self.size[self.number[t]] = depth + 1
        self.fail = array("i", bytes(4 * (len(goto) + 1)))
        self.longest = array("i", [-1]) * (len(goto) + 1)
        for level in by_depth:
            for node, up, c in level:
                f = self.fail[up]
                while f and f * self.width + c not in goto:
                    f = self.fail[f]
                self.fail[node] = goto.get(f * self.width + c, 0) if up else 0
                self.longest[node] = ends.get(node, self.longest[self.fail[node]])
        self.shorter = [self.longest[self.fail[node]] for node in at_label]
        self.size = self.size.tolist()
        self._most_steps = len(goto) + STEP_TABLE
        # a transition has the row of the node it leads to, the longest label that ends there, and that label's size
        self.goto = {k: (n * self.width, self.longest[n], self.size[self.longest[n]]) for k, n in goto.items()}
        self._open: dict[int, bool] = {}

    def _step(self, row: int, c: int) -> tuple[int, int, int]:
        """The transition that the failure arcs lead to; kept."""
        key, into = row + c, None
        while into is None:
            row = self.fail[row // self.width] * self.width
            into = self.goto.get(row + c)
        if len(self.goto) < self._most_steps:
            self.goto[key] = into
        return into

    def _arc(self, state: int, b: int) -> bool:
        """Whether a state has an arc; kept."""
        lo = self.heads[state]
        found = not (bisect_right(self.edges, b, lo, self.heads[state + 1]) - lo) & 1
        if len(self._open) < ARC_TABLE:
            self._open[state << 20 | b] = found
        return found

    def arc(self, a: int, b: int) -> bool:
        """Whether label b can be read after label a (ids)."""
        return self._arc(self.leads[self.number[a]], self.number[b])

    def encode_word(self, word: str) -> list[int]:
        """The ids of the one accepted path that spells the word (byte labels)."""
        if not word:
            return []
        goto, shorter, size, leads, arcs, symbol = self.goto, self.shorter, self.size, self.leads, self._open, self.symbol
        spelled = [symbol.get(c, -1) for c in word]
        if self.suffix:
            spelled[-1] = symbol.get(word[-1] + _END, -1)
        if -1 in spelled:
            raise ValueError("a word has a symbol that the automaton doesn't read")
        path, states = [-1], [-1]  # the label that ends after so many symbols, and where it leads
        row = i = 0
        for c in spelled:
            i += 1
            row, t, n = goto.get(row + c) or self._step(row, c)
            while n != i:
                state = states[i - n]
                there = arcs.get(state << 20 | t)
                if there is None:
                    there = self._arc(state, t)
                if there:
                    break
                t = shorter[t]
                n = size[t]
            path.append(t)
            states.append(leads[t])
        out, i = [], len(spelled)
        while i:
            out.append(self.ids[path[i]])
            i -= size[path[i]]
        return out[::-1]

    def decode(self, path: list[int]) -> list[str]:
        """The labels on the path."""
        return [self.text[t] for t in path]


class WordTokenizer:
    """Normalisation, special strings and word splitting of a word-end BPE file, then the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # normalisation and splitting of texts beyond the plain characters; the model isn't loaded
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.apart = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.words = plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.labels = str.maketrans({chr(b): c for b, c in enumerate(byte_labels())})
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.seen, self.came = bytearray(1 << (SEEN_BITS - 3)), 0

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special strings."""
        if text.isascii() or (max(text) < _PLAIN_BELOW and _CONTEXTUAL not in text):
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        text = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def word(self, word: str) -> tuple[str, str]:
        """The ids and the labels of one word, as text."""
        got = self.older.get(word)
        if got is None:
            path = self.automaton.encode_word(word.encode().decode("latin-1").translate(self.labels))
            got = (" ".join(map(str, path)), " ".join(self.automaton.decode(path)))
            bit = hash(word) & ((1 << SEEN_BITS) - 1)
            if not self.seen[bit >> 3] >> (bit & 7) & 1:  # most words come once and would only push others out
                self.seen[bit >> 3] |= 1 << (bit & 7)
                self.came += 1
                if self.came << 2 > 1 << SEEN_BITS:
                    self.seen, self.came = bytearray(len(self.seen)), 0
                return got
        if len(self.known) >= WORD_TABLE:
            self.known, self.older = {}, self.known
        self.known[word] = got
        return got

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by a space, decoded text."""
        found: list[tuple[str, str]] = []
        for part in self.apart.split(text or "") if text and "<|" in text else [text or ""]:
            if part in self.special:
                found.append((str(self.special[part]), part))
            elif part:
                words = self.split(part)
                got = list(map(self.known.get, words))
                if None in got:
                    got = [x or self.known.get(w) or self.word(w) for x, w in zip(got, words)]
                found += got
        ids = " ".join([x[0] for x in found])
        return ids.count(" ") + bool(ids), ids, " ".join([x[1] for x in found])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, name: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, hashes of ids and of the decoded text; with_ids adds both themselves.

    ``name`` is a file of the public tokenizer package, resolved on each executor.
    One narrow stage: nothing is shuffled.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(_path(name))
        got = [bpe.encode(t) for t in batch.column("text").to_pylist()]
        sha = lambda i: pa.array([hashlib.sha256(x[i].encode()).hexdigest() for x in got], pa.string())
        cols = [batch.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), sha(1), sha(2)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            ids = np.array(" ".join([x[1] for x in got if x[0]]).split(), np.int32)
            ends = np.concatenate([[0], np.cumsum([x[0] for x in got])])
            cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array([x[2] for x in got], pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return arrow_map(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + more)
