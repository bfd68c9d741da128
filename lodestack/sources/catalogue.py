"""The catalogue: entities, relations and score histories as views over the star-schema tables.

A part is an entity, a line item a relation, an event a daily score. The column expressions are plain SQL, so a checker can use
the same text for its own view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Entity columns as SQL over `part`, the same in Spark and DuckDB.
ENTITY_COLUMNS: dict[str, str] = {
    "k": "p_partkey",
    "id": "CASE p_partkey % 5 WHEN 0 THEN 'hf-model--' WHEN 1 THEN 'hf-dataset--' WHEN 2 THEN 'arxiv-paper--' WHEN 3 THEN 'gh-tool--' ELSE 'hf-space--' END || lower(replace(p_brand, '#', '')) || '--' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR(20))",
    "type": "CASE p_partkey % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' WHEN 2 THEN 'paper' WHEN 3 THEN 'tool' ELSE 'space' END",
    "slug": "lower(replace(p_brand, '#', '')) || '--' || replace(p_name, ' ', '-')",
    "name": "p_name || ' ' || CAST(p_partkey % 90 AS VARCHAR(20)) || 'B-v' || CAST(p_partkey % 4 AS VARCHAR(20))",
    "author": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '')) END",
    "source": "CASE p_partkey % 5 WHEN 2 THEN 'arxiv' WHEN 3 THEN 'github' ELSE 'huggingface' END",
    "pipeline_tag": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CASE p_size % 6 WHEN 0 THEN 'text-generation' WHEN 1 THEN 'feature-extraction' WHEN 2 THEN 'image-classification' WHEN 3 THEN 'automatic-speech-recognition' WHEN 4 THEN 'text-to-image' ELSE 'summarization' END END",
    "primary_category": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE lower(p_type) END",
    "license": "CASE p_partkey % 8 WHEN 0 THEN 'mit' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'gpl-3.0' WHEN 3 THEN 'cc-by-nc-4.0' WHEN 4 THEN 'llama2' WHEN 5 THEN 'MPL-2.0' WHEN 6 THEN 'limited use' ELSE NULL END",
    "likes": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 37) % 5000 END",
    "downloads": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey * 7919) % 1000000 END",
    "stars": "CASE WHEN p_partkey % 5 = 3 THEN (p_partkey * 131) % 20000 END",
    "forks": "CASE WHEN p_partkey % 5 = 3 THEN (p_partkey * 17) % 3000 END",
    "citations": "CASE WHEN p_partkey % 5 = 2 THEN (p_partkey * 11) % 900 END",
    "params_billions": "CASE WHEN p_partkey % 5 = 0 AND p_size % 3 > 0 THEN p_size * 1.5E0 END",
    "context_length": "CASE WHEN p_partkey % 5 = 0 AND p_size % 4 > 0 THEN 1024 * (1 + p_size % 32) END",
    "vram_gb": "CASE WHEN p_partkey % 5 = 0 AND p_size % 3 > 0 THEN p_size * 0.75E0 END",
    "last_modified": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE DATE '2024-01-01' - CAST((p_partkey * 31) % 1200 AS INT) END",
    "last_seen": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE DATE '2024-01-01' - CAST(p_partkey % 120 AS INT) END",
    "score": "(p_partkey * 7127) % 1000 / 10.0E0",
    "mesh_points": "(p_partkey * 53) % 400",
    "semantic_score": "CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 71) % 110 * 1.0E0 END",
    "description": "'A ' || p_name || ' for chat and vision with ' || CASE p_partkey % 4 WHEN 0 THEN 'LoRA and qlora adapters' WHEN 1 THEN 'gguf int4 int8 quants' WHEN 2 THEN 'retrieval, rag and embedding vectors' ELSE 'a transformer attention mechanism' END",
    "source_url": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'https://host' || CAST((p_partkey - p_partkey % 4) % 3 AS VARCHAR(20)) || '.example.org/' || CAST(p_partkey - p_partkey % 4 AS VARCHAR(20)) END",
    "has_ollama": "p_partkey % 4 = 0",
    "has_gguf": "p_partkey % 6 = 0",
    "velocity": "p_size / 50.0E0",
}
#: The elements of `tags`.
TAGS = ["substr(p_name, 1, instr(p_name, ' ') - 1)", "substr(p_name, instr(p_name, ' ') + 1)", "lower(p_type)", "'size-' || CAST(p_size % 10 AS VARCHAR(20))", "CASE p_partkey % 6 WHEN 0 THEN 'llama3' WHEN 1 THEN 'qwen2-7b' WHEN 2 THEN 'bert' WHEN 3 THEN 'mixtral-moe' ELSE 'other' END"]

#: Records as sources give them, over the entity columns: each fact under one of several names, or only in a JSON text.
RAW_COLUMNS: dict[str, str] = {
    "k": "k",
    "id": "id",
    "umid": "CASE WHEN k % 3 = 0 THEN 'u' || CAST(k AS VARCHAR(20)) END",
    "slug": "slug",
    "name": "CASE WHEN k % 3 = 0 THEN name END",
    "title": "CASE WHEN k % 3 = 1 THEN name END",
    "display_name": "CASE WHEN k % 3 = 2 THEN upper(name) END",
    "type": "CASE WHEN k % 4 > 0 THEN type END",
    "entity_type": "CASE WHEN k % 8 = 0 THEN type END",
    "author": "CASE WHEN k % 2 = 0 THEN author END",
    "creator": "CASE WHEN k % 5 = 1 THEN author END",
    "organization": "CASE WHEN k % 7 = 1 THEN 'org' || CAST(k % 4 AS VARCHAR(20)) END",
    "description": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE description END",
    "summary": "CASE WHEN k % 10 = 0 THEN 'Summary of ' || name END",
    "readme": "CASE WHEN k % 4 < 2 THEN '# ' || name || ' <b class=\"x\">' || slug || '</b>  *fast*   `run`  and <i>small</i> ' || description END",
    "body_content": "CASE WHEN k % 3 = 1 THEN description || ' ' || description || ' ' || description || ' ' || name END",
    "stars": "CASE WHEN k % 4 = 3 THEN stars END",
    "github_stars": "CASE WHEN k % 8 = 1 THEN k % 77 END",
    "likes": "likes",
    "downloads": "downloads",
    "citations": "citations",
    "fni_score": "CASE WHEN k % 3 > 0 THEN score END",
    "fni": "CASE WHEN k % 6 = 0 THEN score / 2 END",
    "fni_a": "CASE WHEN k % 2 = 0 THEN mesh_points / 5.0E0 END",
    "params_billions": "params_billions",
    "context_length": "CASE WHEN k % 2 = 0 THEN context_length END",
    "license": "CASE WHEN k % 2 = 0 THEN license END",
    "license_spdx": "CASE WHEN k % 3 = 1 THEN 'MIT' END",
    "last_modified": "CASE WHEN k % 2 = 0 THEN CAST(last_modified AS VARCHAR(20)) END",
    "last_updated": "CASE WHEN k % 3 = 0 THEN CAST(last_seen AS VARCHAR(20)) END",
    "source": "CASE WHEN k % 3 > 0 THEN source END",
    "source_platform": "CASE WHEN k % 3 = 0 THEN upper(source) END",
    "source_url": "source_url",
    "pipeline_tag": "pipeline_tag",
    "primary_category": "primary_category",
    "has_ollama": "has_ollama",
    "has_gguf": "has_gguf",
    "velocity": "velocity",
    "model_type": "CASE k % 8 WHEN 0 THEN 'Qwen3NextForCausalLM' WHEN 1 THEN 'GlmMoeDsaForCausalLM' WHEN 2 THEN 'gpt-neox' WHEN 3 THEN 'BertModel' WHEN 4 THEN 'LlamaForCausalLM' WHEN 5 THEN 'gemma4_text' WHEN 6 THEN 'Stable-Diffusion' END",
    "meta": "CASE k % 4 WHEN 0 THEN '{\"stars\":' || CAST(k % 90 AS VARCHAR(20)) || ',\"language\":[\"en\",\"de\"],\"config\":{\"n_embd\":' || CAST(64 * (1 + k % 12) AS VARCHAR(20)) || ',\"n_layer\":' || CAST(2 + k % 30 AS VARCHAR(20)) || ',\"num_local_experts\":8}}' WHEN 1 THEN '{\"hidden_size\":' || CAST(128 * (1 + k % 9) AS VARCHAR(20)) || ',\"language\":\"fr\",\"rows_count\":' || CAST(k * 10 AS VARCHAR(20)) || ',\"runtime\":{\"stage\":\"RUNNING\"},\"categories\":[\"cs.CL\",\"cs.LG\"],\"published_date\":\"20' || CAST(10 + k % 15 AS VARCHAR(20)) || '-05-01\",\"pdf_url\":\"p\",\"authors\":[\"a\",\"b\",\"c\"]}' WHEN 2 THEN '{}' END",
    "files": "CASE WHEN k % 3 = 0 THEN slug || '-Q4_K_M.gguf,' || slug || '-f16.gguf,README.md,' || slug || '_q8_0.GGUF,' || slug || '-Q9_X.gguf,' || slug || '-Q4_K_M.gguf' WHEN k % 3 = 1 THEN 'model.safetensors' END",
}

#: What later steps add to a record, beside the raw columns: counts as numbers or texts, some empty, some no numbers.
ADDED_COLUMNS: dict[str, str] = {
    "category": "CASE k % 7 WHEN 0 THEN 'misc' WHEN 1 THEN '' WHEN 2 THEN 'vision' END",
    "architecture": "CASE WHEN k % 5 = 0 THEN 'llama' END",
    "fni_percentile": "CASE WHEN k % 4 > 0 THEN CAST(k % 100 AS VARCHAR(20)) END",
    "fni_s": "CASE WHEN k % 3 = 0 THEN k % 60 * 1.0E0 END",
    "fni_p": "CASE WHEN k % 3 = 1 THEN k % 70 * 1.0E0 END",
    "fni_r": "CASE WHEN k % 4 = 1 THEN k % 80 * 1.0E0 END",
    "fni_metrics": "CASE WHEN k % 2 = 1 THEN '{\"s\":' || CAST(k % 31 AS VARCHAR(20)) || ',\"a\":7,\"p\":' || CAST(k % 17 AS VARCHAR(20)) || ',\"q\":2.5}' END",
    "raw_pop": "CASE WHEN k % 6 > 0 THEN k % 1000 END",
    "is_trending": "CASE WHEN k % 5 > 0 THEN k % 10 = 3 END",
    "trend_7d": "CASE WHEN k % 9 = 0 THEN '1,2,3' WHEN k % 9 = 1 THEN '' END",
    "image_url": "CASE WHEN k % 2 = 0 THEN 'https://img.example.org/' || CAST(k AS VARCHAR(20)) END",
    "raw_image_url": "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://raw.example.org/' || CAST(k AS VARCHAR(20)) END",
    "vram_estimate_gb": "CASE WHEN k % 5 = 0 THEN k % 90 / 4.0E0 END",
    "task_categories": "CASE k % 8 WHEN 0 THEN repeat('question-answering, ', 40) WHEN 1 THEN 'summarization' END",
    "num_rows": "CASE k % 5 WHEN 1 THEN CAST(k * 10 AS VARCHAR(20)) WHEN 2 THEN '' WHEN 3 THEN 'many' END",
    "primary_language": "CASE WHEN k % 3 = 0 THEN 'en' END",
    "forks": "CASE WHEN k % 5 = 3 THEN k % 300 END",
    "citation_count": "CASE WHEN k % 5 = 2 THEN k % 900 END",
    "runtime_hardware": "CASE WHEN k % 5 = 4 THEN 'cpu-basic' END",
    "vocab_size": "CASE k % 4 WHEN 0 THEN '32000' WHEN 1 THEN 'n/a' WHEN 2 THEN '' END",
    "num_layers": "CASE WHEN k % 4 = 0 THEN k % 90 END",
    "hidden_size": "CASE WHEN k % 4 = 0 THEN 64 * (k % 90) END",
    "datasets_used": "CASE k % 4 WHEN 0 THEN 'Wiki, C4 ,,' WHEN 1 THEN ' ' WHEN 2 THEN repeat('Corpus-of-Texts,', 60) END",
    "quick_start": "CASE k % 6 WHEN 0 THEN repeat('pip install ' || slug || '; ', 80) WHEN 1 THEN 'run ' || slug END",
    "vram_fp16_gb": "params_billions * 2",
    "vram_int8_gb": "params_billions",
    "vram_int4_gb": "params_billions / 2",
    "ui_related_mesh": "CASE WHEN k % 7 = 0 THEN '[{\"id\":\"x\"}]' END",
    "search_vector": "CASE WHEN k % 2 = 0 THEN lower(slug) END",
    "canonical_url": "CASE WHEN k % 3 > 0 THEN 'https://catalogue.example.org/' || slug END",
    "has_fulltext": "k % 9 = 2",
    "hosted_on": "CASE k % 5 WHEN 0 THEN '[\"alpha\"]' WHEN 1 THEN '' END",
    "hosted_on_checked_at": "CASE WHEN k % 5 = 0 THEN '2024-01-0' || CAST(1 + k % 9 AS VARCHAR(20)) END",
    "benchmarks": "CASE WHEN k % 6 = 1 THEN '[{\"name\":\"mmlu\",\"score\":' || CAST(k % 100 AS VARCHAR(20)) || '}]' END",
    "num_heads": "CASE WHEN k % 10 = 0 THEN 8 + k % 56 END",
    "kv_heads": "CASE WHEN k % 20 = 0 THEN 8 END",
    "moe_experts": "CASE WHEN k % 30 = 0 THEN 64 END",
    "moe_active": "CASE WHEN k % 30 = 0 THEN 8 END",
    "sdk": "CASE k % 5 WHEN 4 THEN 'gradio' WHEN 3 THEN '' END",
    "running_status": "CASE WHEN k % 10 = 4 THEN 'RUNNING' END",
    "size_category": "CASE WHEN k % 5 = 1 THEN '10K<n<100K' END",
    "files_count": "CASE WHEN k % 2 = 1 THEN k % 40 END",
    "modality": "CASE k % 5 WHEN 1 THEN 'text' WHEN 2 THEN '' END",
    "published_year": "CASE k % 5 WHEN 2 THEN 2000 + k % 25 WHEN 3 THEN 1800 END",
    "published_date": "CASE WHEN k % 3 = 1 THEN '2019-0' || CAST(1 + k % 9 AS VARCHAR(20)) || '-11' END",
    "created_at": "CASE WHEN k % 2 = 0 THEN '2018-01-01' END",
    "base_model": "CASE WHEN k % 10 = 5 THEN 'base/' || slug END",
    "gguf_variants": "CASE WHEN k % 6 = 0 THEN 'Q4_K_M,Q8_0' END",
    "bundle_key": "'bundles/part-' || CAST(k % 64 AS VARCHAR(20))",
    "bundle_offset": "k * 100",
    "bundle_size": "CASE WHEN k % 8 > 0 THEN 100 END",
}

#: Relation columns over `lineitem`: an entity number on either side.
VERBS = ["CITES", "BASED_ON", "USES", "TRAINED_ON", "EVALUATED_ON", "IMPLEMENTS", "DEP"]
RELATION_COLUMNS: dict[str, str] = {
    "src": "l_partkey",
    "dst": "l_orderkey % 1500",
    "verb": "CASE l_linenumber " + " ".join(f"WHEN {k + 1} THEN '{v}'" for k, v in enumerate(VERBS)) + " END",
    "conf": "CAST(l_quantity * 2 AS INT)",
}
#: Daily scores over `events`.
HISTORY_SQL = "SELECT user_id AS id, CAST(ts AS DATE) AS day, AVG(value) AS score FROM events GROUP BY user_id, CAST(ts AS DATE)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [f"{e} AS {c}" for c, e in ENTITY_COLUMNS.items()]
    return read(spark, sf_dir, "part").selectExpr(*cols, f"array({', '.join(TAGS)}) AS tags")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).selectExpr(*(f"{e} AS {c}" for c, e in RAW_COLUMNS.items()), "tags")


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).selectExpr("*", *(f"{e} AS {c}" for c, e in ADDED_COLUMNS.items()))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in RELATION_COLUMNS.items()))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("user_id AS id", "CAST(ts AS DATE) AS day", "value").groupBy("id", "day").avg("value").withColumnRenamed("avg(value)", "score")
