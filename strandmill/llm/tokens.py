"""Token counts by a given tokenizer: lengths leave the task, token ids never do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.texts import by_bytes, utf8

BATCH_BYTES = 4 << 20
#: Distinct pieces whose counts a worker remembers.
MEMORY = 600_000


def pieces(text: str) -> list[str]:
    """Cut a text before single blanks that stand between two other characters.

    Byte-level pre-tokenization always starts a new word there, and no special token holds a blank,
    so the pieces' counts add up to the count of the text.  A run without such a place stays whole.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    out, open_ = [], parts[0]
    for part in parts[1:]:
        if part and not part[0].isspace() and part[0] != "᠎" and open_ and not open_[-1].isspace() and open_[-1] != "᠎":
            out.append(open_)
            open_ = " " + part
        else:
            open_ += " " + part
    out.append(open_)
    return out


def _counter(path: str):
    """Function of a list of strings to their token counts, for either kind of file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    import json

    state = json.loads(model.to_str())
    level = state.get("pre_tokenizer") or {}
    plain = not state.get("normalizer") and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
    tokens = state.get("added_tokens") or []
    plain = plain and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in tokens)
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], plain


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count, divisible = _counter(path)
        known: dict[str, int] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, totals = memoryview(data), []
            for i, j in by_bytes(offsets, BATCH_BYTES):
                texts = [str(raw[offsets[k]: offsets[k + 1]], "utf-8") for k in range(i, j)]
                if not divisible:
                    totals += count(texts)
                    continue
                cut = [pieces(t) for t in texts]
                if len(known) > MEMORY:
                    known.clear()
                new = list({p for own in cut for p in own} - known.keys())
                for at in range(0, len(new), 20_000):
                    known.update(zip(new[at: at + 20_000], count(new[at: at + 20_000]), strict=True))
                totals += [sum(map(known.__getitem__, own)) for own in cut]
            sizes = offsets[1:] - offsets[:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row, by the tokenizer file ``tokenizer`` (on every worker).

    Texts are encoded in batches of even bytes; where the file's rules allow it, each text is cut at
    safe boundaries and every distinct piece is encoded once per worker memory, so a long text costs
    no more than its words.  No begin, end or padding tokens are added and nothing is truncated; a
    special token's string in a text counts as that token, the library's default.  A null or empty
    text has no bytes and no tokens; a null id stays null; repeated rows are counted alike.
    """
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = pair.mapInArrow(_count(tokenizer), "id long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
