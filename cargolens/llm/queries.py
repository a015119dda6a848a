"""Registered queries of the operators in this package, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted and read back, and one that consists of control strings."""
    from cargolens.llm.chat import format_conversations, loss_text, parse

    hard = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select(*hard.columns).unionByName(hard)

    def digests(batches):
        for batch in batches:
            out = {name: [] for name in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                said, loss = parse(formatted), loss_text(formatted, spans)
                out["n_turns"].append(len(said))
                text = "".join(f"{role}\n{text}\n" for role, text in said)
                out["turns_sha256"].append(sha256(text.encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(formatted))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column(0), **out}, schema=arrow)

    arrow = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
        + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_conversations(turns).mapInArrow(digests, schema)


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17
      ELSE 18 + length(role) END AS marks,
    CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' WHEN 'system' THEN chr(10) || '<</SYS>>'
      ELSE '<|/role|>' END AS closing FROM turns),
escaped AS (
  SELECT *, length(text) + (contains(text, closing)
      OR regexp_matches(text, '([\[<|])\\+(/?INST\]|</?SYS>>|/?s>|\|role:|\|/role\|>|>)'))::INT
    * (length(regexp_replace(text, '([\[<|])(\\*)(/?INST\]|</?SYS>>|/?s>|\|role:|\|/role\|>|>)', '\1\\\2\3', 'g'))
      - length(text)) AS chars FROM marked)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(marks + chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings."""
    from cargolens.llm.neighbours import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in all documents."""
    from cargolens.llm.decontamination import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents."""
    from cargolens.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in all documents."""
    from cargolens.llm.licenses import licenses

    return licenses(table(spark, folder, "documents")).drop("places")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents."""
    from cargolens.llm.quality import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to Arrow files and read back."""
    from cargolens.llm.token_files import read_token_files, write_token_files

    return read_token_files(*write_token_files(table(spark, folder, "documents")))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents by their shingles."""
    from cargolens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    from cargolens.llm.secrets import secrets

    return secrets(table(spark, folder, "documents"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    from cargolens.llm.packing import pack, token_pieces

    return pack(token_pieces(table(spark, folder, "documents")))


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    from cargolens.llm.personal import personal_data

    return personal_data(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for every benchmark item."""
    from cargolens.llm.ranking import ranked

    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents, checked with some of them tampered with."""
    from cargolens.llm.merkle import manifest, proofs, verified

    return verified(proofs(manifest(table(spark, folder, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    numbered = (
        op1_chat_format,
        op2_near_vectors,
        op3_decontamination,
        op4_toxicity,
        op5_licenses,
        op6_quality,
        op7_token_files,
        op8_near_duplicates,
        op9_secrets,
        op10_best_fit_packing,
        op11_personal_data,
        op12_ranked_search,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in numbered} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    from cargolens.llm import licenses, merkle, ranking

    return {
        "op1_chat_format": OP1_SQL,
        "op5_licenses": licenses.sql(),
        "op12_ranked_search": ranking.sql(),
        "op13_merkle_manifest": merkle.sql(),
    }
