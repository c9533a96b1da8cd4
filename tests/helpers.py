def documents(spark, cases):
    """``{dataset: [json, ...]}`` as a documents table."""
    rows = [(d, f"{d}{i}", text) for d, texts in cases.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "dataset string, doc_id string, json string")


def schemas(spark, cases):
    rows = [(d, f"{d}{i}", text) for d, texts in cases.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "dataset string, file string, text string")
