"""How large the batches of texts are that reach Spark's Python workers."""

import uuid

import public_tokenizers
from pyspark import cloudpickle

from lakewright.llm import token_binary

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_are_written_from_small_batches(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, folder = spark.conf.get(name), tmp_path / "sizes"
    folder.mkdir()
    real = token_binary.encoder_for

    def noting(path, end_id):  # reaches the workers with the function of the task
        encoder = real(path, end_id)

        class Noting:
            def encode(self, column):
                (folder / str(uuid.uuid4())).write_text(str(column.nbytes))
                return encoder.encode(column)

        return Noting()

    monkeypatch.setattr(token_binary, "encoder_for", noting)
    cloudpickle.register_pickle_by_value(token_binary)
    try:
        token_binary.write_tokens(spark.range(0, 20_000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) AS text"), str(tmp_path / "t"), TOKENIZER)
    finally:
        cloudpickle.unregister_pickle_by_value(token_binary)
    sizes = [int(p.read_text()) for p in folder.iterdir()]
    assert sum(sizes) > 38 << 20 and max(sizes) < 6 << 20
    assert spark.conf.get(name) == before
