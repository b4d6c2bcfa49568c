"""Token counts that follow edits: a segment tree over the pre-tokens of a document."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import whole_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits text into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A pre-token that ends at least so many characters before an edit can't change: the pattern looks no further ahead.
CONTEXT = 4
#: Pre-tokens of one leaf; remembered token counts of pre-tokens in a worker.
LEAF, REMEMBERED = 64, 400_000


class Counter(dict):
    """Tokens of a pre-token, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(path)


class EditTree:
    """Pre-tokens in leaves of about LEAF; inner nodes hold the sums of characters, pre-tokens and tokens below them.

    An edit re-splits the text from CONTEXT characters before it until a boundary falls on an old one again, re-encodes
    those pre-tokens alone, and renews the sums on the paths from the touched leaves to the root.
    """

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter = text, counter
        self.encoded = 0
        pieces = counter.pattern.findall(text)
        lengths, counts = list(map(len, pieces)), list(map(counter.__getitem__, pieces))
        self._build([(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] or [([], [])])

    def _build(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [(0, 0, 0)] * (2 * self.size)
        for k, (lengths, counts) in enumerate(leaves):
            self.sums[self.size + k] = (sum(lengths), len(lengths), sum(counts))
        for node in range(self.size - 1, 0, -1):
            self._renew(node)

    def _renew(self, node: int) -> None:
        a, b = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def pretokens(self) -> int:
        return self.sums[1][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, start) of the pre-token that holds character `at`; the last one's end if there is none."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.sums[node][0] and self.sums[node + 1][1]:
                start += self.sums[node][0]
                node += 1
        leaf = min(node - self.size, len(self.leaves) - 1)
        place = 0
        for length in self.leaves[leaf][0]:
            if at < start + length:
                break
            start += length
            place += 1
        return leaf, place, start

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces `length` characters from `start`; both are cut to the text."""
        start = max(0, min(start, len(self.text)))
        length = max(0, min(length, len(self.text) - start))
        end, grown = start + length, len(replacement) - length
        new = self.text[:start] + replacement + self.text[end:]
        leaf, place, begin = self._find(max(0, start - CONTEXT))
        # the old pre-tokens from there on, walked along as the new ones are found
        last, old_at, old_end = leaf, place, begin
        lengths, counts = [], []
        done = begin
        for match in self.counter.pattern.finditer(new, begin):
            if done >= start + len(replacement):
                while old_end < done - grown and last < len(self.leaves):
                    if old_at < len(self.leaves[last][0]):
                        old_end += self.leaves[last][0][old_at]
                        old_at += 1
                    else:
                        last, old_at = last + 1, 0
                if old_end == done - grown:
                    break
            lengths.append(match.end() - match.start())
            counts.append(self.counter[match.group()])
            done = match.end()
        else:
            last, old_at = len(self.leaves), 0
        self.encoded += len(lengths)
        self.text = new
        self._splice(leaf, place, last, old_at, lengths, counts)

    def _splice(self, leaf: int, place: int, last: int, old_at: int, lengths: list[int], counts: list[int]) -> None:
        """New pre-tokens instead of those from (leaf, place) up to (last, old_at)."""
        tail = self.leaves[last] if last < len(self.leaves) else ([], [])
        lengths = self.leaves[leaf][0][:place] + lengths + tail[0][old_at:]
        counts = self.leaves[leaf][1][:place] + counts + tail[1][old_at:]
        touched = range(leaf, min(last + 1, len(self.leaves)))
        share = -(-len(lengths) // len(touched))
        if share > 4 * LEAF:
            # much more text than the leaves were made for: new leaves, and the sums once more from the counts
            fresh = [(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)]
            self._build(self.leaves[:leaf] + fresh + self.leaves[touched.stop :])
            return
        above = set()
        for k, at in enumerate(touched):
            self.leaves[at] = (lengths[k * share : (k + 1) * share], counts[k * share : (k + 1) * share])
            self.sums[self.size + at] = (sum(self.leaves[at][0]), len(self.leaves[at][0]), sum(self.leaves[at][1]))
            above.add((self.size + at) // 2)
        while above and 0 not in above:
            for node in above:
                self._renew(node)
            above = {node // 2 for node in above}


def count_edited(docs: DataFrame, edits: Column | str = "edits", vocabulary: str = VOCABULARY, return_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens of the text; edited_pretokens, edited_tokens after its edits; n_edits, n_encoded.

    `edits` is an array of (start, length, replacement) that are applied in turn, each to what the ones before have left;
    places are characters, cut to the text. n_encoded is how many pre-tokens the edits made the tree encode anew. With
    return_text the edited text follows. Each document is a task's own work: nothing is shuffled.

    A null text counts as empty, null edits as none, a null edit is left out, null fields of one as 0 and "". Rows that repeat a doc_id
    are rows of their own. Other columns are ignored. No rows give no rows.
    """
    out = "doc_id long, n_pretokens long, n_tokens long, edited_pretokens long, edited_tokens long, n_edits long, n_encoded long" + ", edited_text string" * return_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns: Sequence[list] = [[] for _ in range(7 + return_text)]
                for doc_id, text, changes in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    tree = EditTree(text.as_py(), counter)
                    row = [doc_id, tree.pretokens, tree.tokens]
                    changes = [c for c in changes or [] if c]
                    for change in changes:
                        start, length, replacement = change.values()
                        tree.edit(start or 0, length or 0, replacement or "")
                    row += [tree.pretokens, tree.tokens, len(changes), tree.encoded] + [tree.text] * return_text
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 7 + [pa.string()] * return_text
                names = [x.split()[0] for x in out.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    changes = F.col(edits) if isinstance(edits, str) else edits
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), changes.alias("edits")).mapInArrow(run, out)
