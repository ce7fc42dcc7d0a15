"""Token ids that leave the pipeline."""

import corpus_pipeline
import public_tokenizers

from tallygrove.llm import bpe


def test_run_keeps_packed_ids(spark, tmp_path):
    out = str(tmp_path / "tokens")
    figures = corpus_pipeline.run(spark, "/root/testdata/sf0.001", out)
    kept = spark.read.parquet(out)
    assert kept.count() == figures.count() > 0 and kept.where("source IS NULL OR octet_length(ids) != 4 * n_tokens OR sha2(ids, 256) != ids_sha256").count() == 0
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoder = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    text = "One line,\nand another: naïve 東京."
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    row = corpus_pipeline.token_counts(spark, docs, "").first()
    assert row.source == "s" and encoder.decode_packed(bytes(row.ids)) == text.encode()


def test_pairs_stay_apart_as_plain_merging_says():
    """Undoing merges tells the same as encoding the joined bytes, in either vocabulary."""
    import random

    import public_tokenizers

    from tallygrove.llm.bpe import Encoder

    rng = random.Random(1)
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(public_tokenizers.path(name), "rb") as ranks:
            encoder = Encoder(ranks.read(), public_tokenizers.PATTERN)
        ids = sorted(encoder.tokens)
        for limit in (400, 3000, len(ids)):
            for _ in range(1500):
                a, b = rng.choice(ids[:limit]), rng.choice(ids[:limit])
                if encoder.starts(a) and encoder.starts(b):
                    joined = encoder.tokens[a] + encoder.tokens[b]
                    assert encoder.follows(a, b) == (encoder.merged(joined) == [a, b])
