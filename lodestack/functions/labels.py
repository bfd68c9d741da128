"""Labels of an entity: licence names, categories, tasks, context lengths, use cases, insights, quality, quantisations, code blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of licences.
LICENSE_NAMES = {
    "apache-2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "mit": "MIT", "gpl-3.0": "GPL-3.0", "gpl-2.0": "GPL-2.0",
    "bsd-3-clause": "BSD-3-Clause", "bsd-2-clause": "BSD-2-Clause", "llama3": "LLaMA-3", "llama-3": "LLaMA-3", "llama2": "LLaMA-2",
    "llama-2": "LLaMA-2", "gemma": "Gemma", "openrail": "OpenRAIL", "openrail++": "OpenRAIL++",
    "bigscience-openrail-m": "BigScience-OpenRAIL-M", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0",
    "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc0-1.0": "CC0-1.0", "unlicense": "Unlicense",
    "wtfpl": "WTFPL", "other": "Other",
}
# The category of a pipeline, tag or source category.
CATEGORIES = {
    "text-generation": ["text-generation", "text2text-generation", "summarization", "translation", "conversational", "other"],
    "knowledge-retrieval": ["question-answering", "fill-mask", "feature-extraction", "sentence-similarity", "text-retrieval"],
    "vision-multimedia": ["image-classification", "image-segmentation", "object-detection", "image-to-image", "image-to-text", "text-to-image", "text-to-video", "video-classification", "automatic-speech-recognition", "text-to-speech", "audio-classification", "audio", "video", "image", "diffusion"],
    "automation-workflow": ["reinforcement-learning", "robotics"],
    "infrastructure-ops": ["tabular-classification", "tabular-regression", "gguf", "awq", "gptq", "exl2", "onnx", "openvino", "tensorrt"],
    "prompts": ["prompts"],
}
CATEGORY_OF = {alias: category for category, aliases in CATEGORIES.items() for alias in aliases}
# Names that tell a category, tried in this order.
CATEGORY_NAMES = {
    "knowledge-retrieval": "embed|bert|bge|e5|retriev|sentence|jina|nomic|gte|minilm|mpnet|indexing|rag|vector|supabase",
    "vision-multimedia": "stable.?diffusion|flux|sdxl|dalle|vision|vit|whisper|tts|wav2vec|clip|upscale|yolo|depth|pose|inpaint",
    "automation-workflow": "agent|autom|robot|reward|rl|decision|planner|tool-use|function-call|action|orchestra",
    "infrastructure-ops": "quantiz|gguf|awq|gptq|exl2|vllm|sglang|trt-llm|ollama|inference|deployment|optimization",
}
# The task of a tag.
TASKS = {
    "coding": ["code", "coder", "code-generation", "code-completion", "codegen", "code-llama"],
    "chat": ["instruct", "chat", "conversational", "assistant", "rlhf"],
    "reasoning": ["reasoning", "math", "gsm8k", "thinking", "o1"],
    "multimodal": ["vision", "multimodal", "vlm", "image-text-to-text", "visual-question-answering"],
    "embedding": ["sentence-similarity", "feature-extraction", "embedding", "rerank"],
    "translation": ["translation", "multilingual"],
    "summarization": ["summarization"],
    "speech": ["automatic-speech-recognition", "text-to-speech", "speech-to-text", "asr", "tts"],
    "image-generation": ["text-to-image", "stable-diffusion", "diffusion", "flux"],
    "vision": ["image-classification", "object-detection", "image-segmentation", "depth-estimation"],
    "audio": ["text-to-audio", "audio-classification"],
    "video": ["text-to-video", "video-classification"],
}
TASK_OF = {tag: task for task, tags in TASKS.items() for tag in tags}
# Words of a name that tell a task.
TASK_NAMES = {
    "coding": r"\b(coder?|codegen|code-?llama|deepseek-?coder|qwen-?coder|starcoder|wizardcoder)\b",
    "reasoning": r"\b(o1|o3|reasoning|qwq|deepseek-?r1|thinking)\b",
    "multimodal": r"\b(vision|vl|llava|cogvlm|qwen-?vl|gemini-?vision)\b",
    "embedding": r"\b(embedd?ing|bge|e5|sentence-transformer)\b",
    "chat": r"\b(chat|instruct|assistant|dpo|orpo)\b",
}
# Tokens of context by family.
CONTEXT_LENGTH = {
    "llama": 8192, "mistral": 32768, "mixtral": 32768, "qwen2": 32768, "qwen3": 32768, "gemma": 8192, "gemma2": 8192, "phi": 2048,
    "phi3": 4096, "phi4": 16384, "gpt2": 1024, "gpt_neox": 2048, "gpt_bigcode": 8192, "starcoder2": 16384, "bert": 512, "roberta": 512,
    "albert": 512, "deberta": 512, "distilbert": 512, "t5": 512, "bart": 1024, "mbart": 1024, "pegasus": 1024, "falcon": 2048,
    "bloom": 2048, "opt": 2048, "mpt": 2048, "stable-diffusion": 77, "sdxl": 77, "flux": 77, "whisper": 448, "deepseek": 4096,
    "internlm": 4096, "internlm2": 32768, "baichuan": 4096, "yi": 4096, "chatglm": 8192, "glm": 8192, "cohere": 8192,
    "command-r": 131072, "jamba": 262144, "nemotron": 8192, "minimax": 32768,
}
# Families by which a name may begin, tried in this order.
FAMILIES = [
    "qwen3", "qwen2", "qwen", "gemma2", "gemma", "phi4", "phi3", "phi", "starcoder2", "gpt_bigcode", "gpt_neox", "gpt2", "internlm2",
    "internlm", "chatglm", "glm", "llama", "mistral", "mixtral", "deepseek", "falcon", "bloom", "opt", "mpt", "whisper", "cohere",
    "baichuan", "yi", "t5", "bart", "mbart", "pegasus", "bert", "roberta", "albert", "deberta", "distilbert", "flux", "sdxl", "jamba",
    "nemotron", "minimax", "command-r",
]
# Endings that name a head or a variant, not a family.
HEADS = "(?:forconditionalgeneration|forsequenceclassification|fortokenclassification|forquestionanswering|forseq2seqlm|forcausallm|formaskedlm|forlm|model)$"
VARIANTS = "(?:moedsa|moe|next|lite|flash|cascade|fast|tiny|mini|small|large|xl|xxl|deepslim|hslim|h)$"
# The pipeline of a task as people say it, tried in this order.
TASK_ALIASES = {
    "llm": "text-generation", "chat": "text-generation", "chatbot": "text-generation", "code": "text-generation",
    "code-generation": "text-generation", "coding": "text-generation", "write": "text-generation", "generate-text": "text-generation",
    "completion": "text-generation", "instruct": "text-generation", "assistant": "text-generation", "diffusion": "text-to-image",
    "image-generation": "text-to-image", "art": "text-to-image", "generate-image": "text-to-image", "stable-diffusion": "text-to-image",
    "translate": "translation", "translator": "translation", "summarize": "summarization", "summarise": "summarization",
    "speech-to-text": "automatic-speech-recognition", "transcribe": "automatic-speech-recognition", "asr": "automatic-speech-recognition",
    "voice": "text-to-speech", "tts": "text-to-speech", "classify": "text-classification", "sentiment": "text-classification",
    "ner": "token-classification", "qa": "question-answering", "rag": "feature-extraction", "embeddings": "feature-extraction",
    "embed": "feature-extraction", "embedding": "feature-extraction", "rerank": "feature-extraction", "detect": "object-detection",
    "segment": "image-segmentation", "ocr": "image-to-text", "caption": "image-to-text", "fill-mask": "fill-mask",
    "video": "text-to-video", "audio": "text-to-audio", "depth": "depth-estimation",
}
# Pipelines that are named as they are.
PIPELINES = [
    "text-generation", "text2text-generation", "text-to-image", "image-to-text", "text-classification", "token-classification",
    "question-answering", "summarization", "translation", "fill-mask", "feature-extraction", "sentence-similarity",
    "automatic-speech-recognition", "text-to-speech", "text-to-audio", "text-to-video", "object-detection", "image-segmentation",
    "image-classification", "depth-estimation", "zero-shot-classification", "conversational", "reinforcement-learning",
    "tabular-classification", "unconditional-image-generation", "image-to-image",
]
# By type, what a tag is good for.
USES = {
    "model": {"text-generation": "Chat & Dialogue", "code": "Coding Assistant", "python": "Coding Assistant", "translation": "Translation", "summarization": "Content Summary", "rag": "RAG Systems", "knowledge": "RAG Systems", "text-to-image": "AI Art Gen"},
    "agent": {"framework": "Agent Orchestration", "mcp-server": "External Tools", "autonomous": "Long-term Planning"},
    "paper": {"nlp": "Language Theory", "cv": "Object Detection", "benchmark": "Model Analytics"},
    "dataset": {"sft": "Instruction Tuning", "rlhf": "Alignment Training", "pretrain": "Base Training"},
    "space": {"chat": "Live Sandbox"},
    "tool": {"deployment": "Model Serving"},
}
# Quantisations, the best first.
QUANTISATIONS = ["F32", "F16", "Q8_0", "Q6_K", "Q5_K_M", "Q5_K_S", "Q4_K_M", "Q4_K_S", "Q4_0", "Q3_K_M", "Q2_K"]
# Names that tell an architecture's family, and what stands for unknown facts.
FAMILY_NAMES = ["llama", "qwen", "mistral", "gemma", "phi", "deepseek", "gpt", "falcon", "bloom", "mpt"]
DEFAULT_PARAMS, DEFAULT_CONTEXT, DEFAULT_FAMILY = 7.0, 8192, "transformer"
# Languages of a code block, tried in this order, and what each is called; the last takes any.
CODE_LANGUAGES = {"python": "python", "bash": "bash", "shell": "bash", "javascript": "javascript", "js": "js", "": "code"}
# Prefixes of a benchmark id and those of the same family elsewhere.
FAMILY_PREFIXES = {"llama-": "meta-llama-", "mistral-": "mistralai-", "deepseek-": "deepseek-ai-", "gemma-": "google-", "phi-": "microsoft-"}


def mapped(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def first_name(text: Column, patterns: dict[str, str]) -> Column:
    """The key of the first pattern that a text has; null if none."""
    return F.coalesce(*(F.when(text.rlike(p), name) for name, p in patterns.items()))


def license_name(raw: Column) -> Column:
    """The usual name of a licence; one that isn't known stays as it is."""
    return F.coalesce(mapped(F.lower(F.trim(raw)), LICENSE_NAMES), F.nullif(raw, F.lit("")))


def category(primary: Column, pipeline: Column, tags: Column, name: Column) -> Column:
    """By source category, then pipeline, then the first tag that tells one, then the name, then text generation."""
    of_tag = F.get(F.filter(F.transform(tags, lambda t: mapped(t, CATEGORY_OF)), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(mapped(primary, CATEGORY_OF), mapped(pipeline, CATEGORY_OF), of_tag, first_name(F.lower(name), CATEGORY_NAMES), F.lit("text-generation"))


def tasks(pipeline: Column, tags: Column, name: Column) -> Column:
    """Sorted tasks of pipeline, tags and name; chat for a text generator of which nothing else is known."""
    low = F.lower(F.coalesce(pipeline, F.lit("")))
    of_name = F.array(*(F.when(F.lower(name).rlike(p), task) for task, p in TASK_NAMES.items()))
    found = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(F.concat(F.array(low), tags), lambda t: mapped(F.lower(F.trim(t)), TASK_OF)), of_name))))
    return F.when((F.size(found) == 0) & (low == "text-generation"), F.array(F.lit("chat"))).otherwise(found)


def context_length(model_type: Column) -> Column:
    """Tokens of context of an architecture as named in a config: by its whole name, or by the family that it begins with."""
    low = F.lower(model_type)
    bare = lambda x: x.replace("-", "").replace("_", "")
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, HEADS, ""), "[-_]", ""), VARIANTS, "")
    family = F.coalesce(*(F.when(key.startswith(bare(f)), F.lit(f)) for f in FAMILIES))
    return F.coalesce(mapped(key, CONTEXT_LENGTH), mapped(F.replace(low, F.lit("-"), F.lit("_")), CONTEXT_LENGTH), mapped(low, CONTEXT_LENGTH), mapped(family, CONTEXT_LENGTH))


def pipeline_of_task(task: Column) -> Column:
    """(tag, confidence): 1.0 for a pipeline's own name, 0.9 for an alias, 0.7 for a text that holds one, 0.5 for others, 0.3 for none."""
    low = F.lower(F.trim(task))
    held = F.coalesce(*(F.when(F.contains(low, F.lit(a)), F.lit(p)) for a, p in TASK_ALIASES.items()))
    pair = lambda tag, c: F.struct(tag.alias("tag"), F.lit(c).alias("confidence"))
    alias = mapped(low, TASK_ALIASES)
    return F.when(task.isNull() | (task == ""), pair(F.lit("text-generation"), 0.3)).when(low.isin(PIPELINES), pair(low, 1.0)).when(alias.isNotNull(), pair(alias, 0.9)).when(held.isNotNull(), pair(held, 0.7)).otherwise(pair(low, 0.5))


def good_for(type: Column, tags: Column, pipeline: Column, score: Column) -> Column:
    """At most three uses by type and tags, in the order of the table; a score of 90 or more adds a badge at the end."""
    low = F.transform(F.array_compact(F.concat(tags, F.array(pipeline))), F.lower)
    found = [F.when((type == kind) & F.array_contains(low, tag), use) for kind, uses in USES.items() for tag, use in uses.items()]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found, F.when(score >= 90, "SOTA Performance")))), 1, 3)


def limits(type: Column, tags: Column, license: Column, score: Column) -> Column:
    """At most two limits of a model."""
    low = F.transform(tags, F.lower)
    text = F.array_join(low, " ")
    closed = F.contains(F.lower(F.coalesce(license, F.lit(""))), F.lit("non-commercial")) | F.contains(text, F.lit("cc-by-nc")) | F.contains(text, F.lit("research-only"))
    found = F.array(F.when((score < 50) & (score > 0), "Experimental / High Latency"), F.when(F.array_contains(low, "small-model"), "Limited Complexity"), F.when(closed, "Non-Commercial Use"))
    return F.when(type == "model", F.slice(F.array_compact(found), 1, 2)).otherwise(F.array().cast("array<string>"))


def insights(score: Column, params: Column, context: Column, vram: Column, architecture: Column, license: Column) -> Column:
    """Label, value and badge of a model's facts, those that are known."""
    row = lambda label, value, badge: F.struct(F.lit(label).alias("label"), value.alias("value"), badge.alias("badge"))
    none = F.lit(None).cast("string")
    low = F.lower(license)
    open_ = F.contains(low, F.lit("apache")) | F.contains(low, F.lit("mit"))
    return F.array_compact(
        F.array(
            F.when(score > 0, row("FNI Score", score.cast("string"), F.when(score > 90, "High FNI signal").when(score > 70, "Medium FNI signal").otherwise("Low FNI signal"))),
            row("Params", F.coalesce(F.when(params != 0, F.concat(params.cast("string"), F.lit("B"))), F.lit("-")), F.when(params < 3, "Tiny").when(params > 100, "Massive").otherwise(none)),
            row("Context", F.coalesce(F.when(context != 0, F.concat(F.floor(context / 1024 + 0.5).cast("string"), F.lit("k"))), F.lit("-")), F.when(context >= 128000, "Long").otherwise(none)),
            F.when(vram != 0, row("Est. VRAM", F.concat(F.lit("~"), F.ceil(vram).cast("string"), F.lit("GB")), F.when(vram <= 8, "8G GPU").when(vram <= 24, "24G GPU").otherwise("H100+"))),
            F.when(architecture != "", row("Architecture", F.upper(architecture), F.when(F.contains(architecture, F.lit("moe")), "MoE Expert").otherwise("Dense"))),
            F.when(license != "", row("License", F.upper(F.split_part(low, F.lit("-"), F.lit(1))), F.when(open_, "Commercial").otherwise("Restricted"))),
        )
    )


def paper_quality(body: Column, authors: Column, tags: Column, pdf: Column, title: Column) -> Column:
    """Up to 100 points for abstract, authors, categories, a PDF and a title."""
    n, points = F.coalesce(F.length(body), F.lit(0)), lambda c, x: F.when(c, x).otherwise(0)
    return F.least(F.lit(100), points(n > 200, 20) + points(n > 500, 10) + F.least(F.lit(20), F.coalesce(authors, F.lit(0)) * 5) + points(F.size(tags) > 0, 20) + points(pdf.isNotNull(), 10) + points(F.length(title) > 20, 10))


def entity_quality(body: Column, image: Column, license: Column, popularity: Column) -> Column:
    """Up to 100 points for contents, assets and popularity, one decimal."""
    n, points = F.coalesce(F.length(body), F.lit(0)), lambda c, x: F.when(c, x).otherwise(0)
    total = points(n > 500, 10) + points(n > 2000, 15) + points(n > 10000, 15) + points(image.isNotNull(), 20) + points(license.isNotNull(), 10) + F.least(F.lit(30.0), F.log10(F.coalesce(popularity, F.lit(0)) + 1) * 10)
    return F.floor(total * 10 + 0.5) / 10


def gguf_variants(files: Column) -> Column:
    """Quantisations that the GGUF files of a list name, each once, the best first, unknown ones last in their order."""
    ours = F.filter(files, lambda f: F.lower(f).endswith(".gguf"))
    named = F.transform(ours, lambda f: F.upper(F.regexp_extract(f, r"(?i)[_-](Q\d+_[A-Z0-9_]+|f16|f32|int[48])", 1)))
    kept = F.array_distinct(F.filter(named, lambda v: v != ""))
    known = F.array(*map(F.lit, QUANTISATIONS))
    return F.concat(F.filter(known, lambda v: F.array_contains(kept, v)), F.filter(kept, lambda v: ~F.array_contains(known, v)))


def code_block(text: Column) -> Column:
    """(language, code, lines) of the first block of a preferred language that has 20 characters and isn't just an installation."""

    def block(mark: str, name: str) -> Column:
        code = F.btrim(F.regexp_extract(text, rf"(?i)```{mark}\s*([\s\S]*?)```", 1), F.lit(" \t\r\n"))
        lines = F.size(F.split(code, "\n"))
        usable = (F.length(code) >= 20) & ~(code.startswith("pip install") & (lines < 3))
        return F.when(usable, F.struct(F.lit(name).alias("language"), F.substring(code, 1, 2000).alias("code"), lines.alias("lines")))

    return F.coalesce(*(block(mark, name) for mark, name in CODE_LANGUAGES.items()))


def percent_change(a: Column, b: Column) -> Column:
    return F.when(b.isNull() | (b == 0), 0.0).otherwise((a - b) / b * 100)


def benchmark_key(raw: Column) -> Column:
    """A benchmark id with single dashes and without the endings that name a tuning."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[_.]", "-"), "-+", "-")
    bare = F.regexp_replace(dashed, "^-|-$", "")
    for end in ("-instruct$", "-chat$", "-base$"):
        bare = F.regexp_replace(bare, end, "")
    return bare


def benchmark_variants(raw: Column) -> Column:
    """Names under which the entity of a benchmark id may be listed, in order of preference."""

    def forms(base: Column) -> Column:
        dotted = F.regexp_replace(base, r"-(\d+)-(\d+)([^-]*)$", "-$1.$2$3")
        out = [base, *(F.concat(base, F.lit(x)) for x in ("-instruct", "-chat", "-base")), F.when(dotted != base, dotted), F.when(dotted != base, F.concat(dotted, F.lit("-instruct")))]
        for own, other in FAMILY_PREFIXES.items():
            variant = F.when(base.startswith(own), F.concat(F.lit(other), F.substring(base, F.lit(len(own) + 1), F.length(base))))
            out += [variant, F.concat(variant, F.lit("-instruct"))]
        return F.array(*out)

    # a lambda's argument is evaluated once, not once for each form
    return F.array_distinct(F.array_compact(F.transform(F.array(benchmark_key(raw)), forms)[0]))


def canonical_name(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(raw), r"[/\s._-]+", "-"), "^-|-$", "")


def family(name: Column) -> Column:
    return F.coalesce(first_name(F.lower(name), {f: f for f in FAMILY_NAMES}), F.lit(DEFAULT_FAMILY))


def velocity(likes: Column, downloads: Column, age_days: Column) -> Column:
    """Likes a day and a tenth of the downloads a day."""
    age = F.greatest(age_days, F.lit(1))
    return F.coalesce(likes, F.lit(0)) / age + F.coalesce(downloads, F.lit(0)) / age / 10


def popularity(likes: Column, downloads: Column) -> Column:
    return F.coalesce(likes, F.lit(0)) * 2 + F.coalesce(downloads, F.lit(0)) * 0.1


def plain_week(day: Column) -> Column:
    """Year and week, weeks beginning on Sundays and counted from January 1."""
    first = F.trunc(day, "year")
    return F.format_string("%d-W%02d", F.year(day), F.ceil((F.datediff(day, first) + F.dayofweek(first)) / 7).cast("int"))


def display_name(name: Column, id: Column) -> Column:
    """The name, or one made of the id where that is missing or a slug; bare paper numbers are called papers."""
    number = r"^\d{4}\.\d{4,5}$"
    slug = ~F.contains(name, F.lit(" ")) & name.rlike("[-_]")
    poor = name.isNull() | name.isin("", "Unknown", "Unknown Model", "Unknown Entity") | slug | (name == id) | name.rlike(number)
    last = F.element_at(F.split(id, "--"), -1)
    words = F.filter(F.split(F.regexp_replace(last, "[-_]", " "), " "), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(~poor, name).when(F.coalesce(name.rlike(number), F.lit(False)) | last.rlike(number), F.concat(F.lit("Paper "), last)).otherwise(made)
