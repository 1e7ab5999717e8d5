import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from relayout.llm import secrets
from relayout.llm.shared import stored

from .conftest import SF
from .test_jaccard import brute as components


def test_registered():
    names = __spark_entry__.queries()
    assert {name.split("_")[0] for name in names if name.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()


def test_stages_against_brute_force(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id: r for r in after.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        docs = after
        if name == "language":
            assert set(kept[name]) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "near_duplicates":
            comps = components([(i, r.text) for i, r in sorted(before.items())], 5, 80, 100)
            assert set(kept[name]) == {i for i, _, comp in comps if i == comp}
        if name == "decontamination":
            items = [text.lower().split() for (text,) in duck.execute("SELECT text FROM benchmark").fetchall()]
            items = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in items]

            def hit(text):
                words = text.lower().split()
                own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
                return any(5 * len(own & item) >= 4 * len(item) for item in items)

            assert set(kept[name]) == {i for i, r in before.items() if not hit(r.text)}
        if name == "secrets":
            assert set(kept[name]) == set(before)
            changed = {i for i in before if before[i].text != kept[name][i].text}
            assert all(secrets.REDACTED in kept[name][i].text for i in changed)
            assert all(kept[name][i].n_chars == len(kept[name][i].text) for i in changed)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(pieces) == set(kept["secrets"])
    for i, r in kept["secrets"].items():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        assert b"".join(part for _, part in sorted(pieces[i])) == b"".join(x.to_bytes(4, "little") for x in ids)


def test_odd_rows(spark, frame, odd_texts, tmp_path):
    frame(odd_texts).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "one id " * 10), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and 90 not in {r.doc_id for r in out if r.start == 0 and r.doc_tokens == 62}


def test_no_rows(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ownership_redacts_only_owned_values(spark):
    own, copied = "token=ownsecretvalue01", "token=examplevalue0001"
    rows = [(i, f"text {copied} end", "en", f"src{i}", 30) for i in range(4)]
    rows += [(10, f"{own} and {copied}", "en", "src9", 40), (11, None, "en", "src9", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert texts[0] == f"text {copied} end" and texts[11] is None
    assert texts[10] == f"token={secrets.REDACTED} and {copied}"
