"""The boundary to external models: a provider is a callable from a batch of prompts to JSON texts, injected by the caller.

Whatever comes back is checked against a schema and against what was sent; what fails is asked once more with the error, and then left out with a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]
MOST_BYTES = 65_536
FINDINGS = "array<struct<category:string,severity:string,statement:string,evidence_ids:array<string>,confidence:double>>"
CATEGORIES = ("QUALITY", "DELIVERY", "AFTER_SALES", "PRODUCT_MISMATCH", "PACKAGING", "OTHER")
SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH")


def answered(requests: DataFrame, provider: Provider, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds the provider's answers. Prompts over the byte budget are not sent and have a null answer; batches are Arrow batches."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in requests.schema.fields if f.name != answer]).add(answer, StringType())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prompts = batch.column(prompt).to_pylist()
            send = [i for i, p in enumerate(prompts) if p and len(p.encode()) <= MOST_BYTES]
            got: list[str | None] = [None] * len(prompts)
            for i, a in zip(send, provider([prompts[i] for i in send]) if send else [], strict=True):
                got[i] = a
            keep = [n for n in batch.schema.names if n != answer]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(got, pa.string())], [*keep, answer])

    return requests.mapInArrow(run, schema)


def finding_error(answer: Column, allowed: Column) -> Column:
    """Why an answer is no list of findings about the evidence that was sent; null if it is one."""
    found = F.from_json(answer, FINDINGS)
    bad = lambda test: F.exists(found, test)
    return (
        F.when(answer.isNull(), "no answer").when(found.isNull(), "no findings")
        .when(bad(lambda f: ~F.coalesce(f["category"].isin(*CATEGORIES), F.lit(False)) | ~F.coalesce(f["severity"].isin(*SEVERITIES), F.lit(False))), "unknown category or severity")
        .when(bad(lambda f: F.coalesce(F.size(f["evidence_ids"]), F.lit(0)).between(1, 20) == F.lit(False)), "1 to 20 evidence ids")
        .when(bad(lambda f: F.size(F.array_distinct(f["evidence_ids"])) != F.size(f["evidence_ids"])), "repeated evidence ids")
        .when(bad(lambda f: F.size(F.array_except(f["evidence_ids"], allowed)) > 0), "evidence that was not sent")
        .when(bad(lambda f: ~F.coalesce(f["confidence"].between(0, 1), F.lit(False))), "confidence from 0 to 1")
    )


def interpreted(requests: DataFrame, provider: Provider) -> DataFrame:
    """requests: request_id, prompt, evidence_ids. Returns request_id, findings (array), error, calls: at most one repair with the error in its prompt."""
    first = answered(requests, provider).withColumn("error", finding_error(F.col("answer"), F.col("evidence_ids"))).withColumn("calls", F.when(F.col("answer").isNull(), 0).otherwise(1))
    again = first.where("error is not null and answer is not null").withColumn("prompt", F.concat_ws("\n", "prompt", F.concat(F.lit("The last answer was rejected: "), F.col("error")))).drop("answer", "error")
    second = answered(again, provider).withColumn("error", finding_error(F.col("answer"), F.col("evidence_ids"))).withColumn("calls", F.lit(2))
    both = first.where("error is null or answer is null").select("request_id", "answer", "error", "calls").unionByName(second.select("request_id", "answer", "error", "calls"))
    return both.select("request_id", F.when(F.col("error").isNull(), F.from_json("answer", FINDINGS)).alias("findings"), "error", "calls")


def media_factors(findings: DataFrame) -> DataFrame:
    """Mean of 1 + (multiplier - 1) * confidence over a review's media: review_id, factor. findings: review_id, consistency, confidence."""
    base = F.create_map(*(F.lit(x) for pair in {"SUPPORTS": 1.10, "PARTIALLY_SUPPORTS": 1.0, "CONTRADICTS": 0.5, "CANNOT_DETERMINE": 1.0}.items() for x in pair))[F.col("consistency")]
    return findings.groupBy("review_id").agg(F.avg(1 + (F.coalesce(base, F.lit(1.0)) - 1) * F.col("confidence")).alias("factor"))


def completed_media(media: DataFrame, findings: DataFrame) -> DataFrame:
    """Every accessible item has a finding: what the model left out is CANNOT_DETERMINE with confidence 0. Keys: review_id, media_id."""
    return media.where("accessible").select("review_id", "media_id").join(findings, ["review_id", "media_id"], "left").select("review_id", "media_id", F.coalesce("consistency", F.lit("CANNOT_DETERMINE")).alias("consistency"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


MOST_TEXTS, MOST_CHARACTERS = 64, 4000
Embedder = Callable[[list[str]], list[tuple[int, list[float]]]]


def embedded(texts: DataFrame, provider: Embedder, id_col: str = "id", text_col: str = "text", most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Vectors of texts from an external model: the id, vector, error.

    Trimmed texts are packed into calls of most_texts and most_bytes at most, across Arrow batches. A call answers (place in the call, vector) in any order; it is taken only if every
    place is there once and all vectors have one dimension, the same for every call of a task, and finite entries. Otherwise, or if the call raises, its rows carry the reason.
    Blank texts and those over MOST_CHARACTERS are not sent.
    """
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        import math

        import pyarrow as pa

        def checked(answer, n, dimension):
            vectors = {int(i): [float(x) for x in v] for i, v in answer}
            if len(answer) != n or sorted(vectors) != list(range(n)):
                raise ValueError("incomplete answer")
            sizes = {len(v) for v in vectors.values()} | ({dimension} if dimension else set())
            if len(sizes) > 1 or 0 in sizes:
                raise ValueError("unequal dimensions")
            if not all(math.isfinite(x) for v in vectors.values() for x in v):
                raise ValueError("numbers that are not finite")
            return [vectors[i] for i in range(n)]

        held, size, dimension, kinds = [], 0, None, None

        def record(rows):
            ids, vectors, errors = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], [id_col, "vector", "error"])

        def sent():
            nonlocal held, size, dimension
            rows, held, size = held, [], 0
            try:
                vectors = checked(provider([t for _, t in rows]), len(rows), dimension)
                dimension = len(vectors[0])
                return record([(i, v, None) for (i, _), v in zip(rows, vectors, strict=True)])
            except Exception as failure:  # whatever a provider raises is the rows' error
                return record([(i, None, str(failure)[:200] or type(failure).__name__) for i, _ in rows])

        for batch in batches:
            kinds = batch.column(0).type
            refused = []
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").strip()
                n = len(text.encode())
                if not text or len(text) > MOST_CHARACTERS or n > most_bytes:
                    refused.append((owner, None, "text of no length" if not text else "text too long"))
                    continue
                if held and (len(held) == most_texts or size + n > most_bytes):
                    yield sent()
                held.append((owner, text))
                size += n
            if refused:
                yield record(refused)
        if held:
            yield sent()

    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, vector array<double>, error string")
