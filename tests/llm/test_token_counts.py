import random

import public_tokenizers
from tokenizers import Tokenizer

from relayout.llm import queries, token_counts

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def size(text):
    return len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)


def test_given_table(spark, documents):
    found = {row.doc_id: row for row in queries.QUERIES["op9_token_counts"](spark, SF).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for doc_id, text, *_ in documents:
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        row = found.pop(doc_id)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), want, want > 2048)
    assert not found


def test_splice_is_exact():
    seed = random.Random(4)
    parts = [*"aé'sTré ́\t\n1 2!#ß한가  ẛΣ", "<|endoftext|>", "'ll ", "\x0b\x0c\x1c"]
    starts = token_counts.token_starts(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(400):
        text = "".join(seed.choices(parts, k=seed.randint(0, 200)))
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((16, 2), (5, 3), (40, 8)):
            assert token_counts.spliced_count(text, starts, chunk, overlap) == want


def test_without_any_boundary():
    starts = token_counts.token_starts(PATH)
    for text in ("a" * 3000, "é한1!" * 700, " " * 2000, "word " + "x" * 2500):
        assert token_counts.spliced_count(text, starts, 100, 10) == size(text)


def test_odd_rows(frame, odd_texts):
    docs = frame([*odd_texts, "a\x0bb\x0cc\x1cd\x85e f g"])
    found = sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PATH, 500, 20).collect())
    texts = [row.text or "" for row in docs.collect()]
    assert found == sorted((len(text.encode()), size(text)) for text in texts)
    assert token_counts.count_tokens(frame([]), PATH).count() == 0
