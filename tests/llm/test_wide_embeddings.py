import pytest
from draftloom.llm import binary_search


def test_wider_embeddings_are_an_error(spark):
    df = spark.createDataFrame([([1.0] * 65,)], "embedding array<float>")
    with pytest.raises(Exception, match="65 components"):
        df.select(binary_search.sign_code(df.embedding).alias("code")).collect()
