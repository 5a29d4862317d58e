"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match-first splits a word into the longest vocabulary piece at each point. The automaton reads
each byte once: where the trie has no way on, a failure link goes to the node of what remains after popping
the pieces that greedy matching would have taken, and the number popped is stored with the link, so lengths
come out without building pieces.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import prefixed, with_arrow_columns

#: Letter runs, single digits, and runs of other visible characters, as the vocabulary's own rule has it.
WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Distinct words whose counts a worker remembers before it starts anew.
CACHE_WORDS = 400_000


class PieceCounter:
    """The automaton of a set of byte pieces."""

    def __init__(self, pieces: set[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in sorted(pieces):
            node = 0
            for b in piece:
                nxt = self.edges[node].get(b)
                if nxt is None:
                    nxt = self.edges[node][b] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = nxt
            if piece:
                final[node] = True
        n = len(self.edges)
        #: where to go on when a node has no way on (-1: the word has no split), and pieces popped on the way
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [0]
        for u in queue:
            for b, v in self.edges[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and b not in self.edges[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z][b], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 for a word that has no split (one unknown piece); 0 for an empty word."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for b in word:
            while (nxt := edges[node].get(b)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 0:
            total += popped[node]
            node = fail[node]
        return 1 if node < 0 else total


def load_pieces(path: str) -> set[bytes]:
    """The byte pieces of a tokenizer file's vocabulary, without word-end marks and special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    # printable stand-ins for bytes: visible Latin-1 stands for itself, the rest follows from 256 on
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    to_byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    out = {bytes([b]) for b in range(256)}
    for token in spec["model"]["vocab"]:
        if token not in special:
            out.add(bytes(to_byte[c] for c in token.removesuffix("</w>")))
    return out - {b""}


def count_pieces(df: DataFrame, pieces: set[bytes], text_col: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``df`` plus ``n_words``, ``n_pieces`` and ``max_pieces`` (of one word), all long.

    Texts are lower-cased and cut by ``WORD``; null and empty texts have zeros. The vocabulary, bounded by its
    file, is broadcast; each worker builds the automaton once and remembers counts of a bounded set of words.
    """
    shared = df.sparkSession.sparkContext.broadcast(sorted(pieces))

    def make():
        counter, known = PieceCounter(set(shared.value)), {}

        def work(batch):
            words, total, most = [], [], []
            for t in batch.column(batch.schema.get_field_index(text_col)):
                found = WORD.findall((t.as_py() or "").lower())
                for w in set(found):
                    if w not in known:
                        known[w] = counter.count(w.encode("utf-8", "surrogatepass"))
                counts = [known[w] for w in found]
                words.append(len(found))
                total.append(sum(counts))
                most.append(max(counts, default=0))
                if len(known) > CACHE_WORDS:
                    known.clear()
            return [pa.array(x, pa.int64()) for x in (words, total, most)]

        return work

    fields = prefixed([("n_words", T.LongType()), ("n_pieces", T.LongType()), ("max_pieces", T.LongType())], prefix)
    return with_arrow_columns(df, make, fields, [] if keep_text else [text_col])


def op3_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Word-piece counts of every document, by the vocabulary of a public tokenizer file."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_pieces(docs, load_pieces(vocabulary or public_tokenizers.path("word_bpe_49k.json")), keep_text=False)
