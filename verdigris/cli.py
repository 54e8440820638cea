"""Commands: dataset, watermark, paraphrase, detect, analyze, pipeline.

``python -m verdigris.cli COMMAND --help`` tells the options of each. Tables
between the steps are Parquet; ``--csv`` exports each step's result as files
of the usual names and columns besides, and ``read_combined`` takes such files
back.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import utilities
from verdigris.config import EXPERIMENTS, Settings, load
from verdigris.functions import text as functions
from verdigris.operators import corpus, decoding, detection, generation, metrics, paraphrasing, reshape, stability, subwords, windows
from verdigris.sources import storage

STEPS = ("dataset", "watermark", "paraphrase", "detect", "combine", "rolling", "pss")


def session() -> SparkSession:
    return SparkSession.builder.appName("verdigris").getOrCreate()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or a folder of text files if the path ends in .txt or a slash and star."""
    return storage.read_texts(spark, path).withColumn("doc_id", F.xxhash64("filename")) if path.endswith((".txt", "*")) else spark.read.parquet(path)


def save(df: DataFrame, path: str, csv: bool = False) -> None:
    storage.write_csv(df, path, single=True) if csv else df.write.mode("overwrite").parquet(path)


def export(df: DataFrame, a: argparse.Namespace, name: str) -> None:
    """One CSV folder of one file below ``csv``, if wanted."""
    if a.csv:
        save(df, f"{a.output}/csv/{name}.csv", csv=True)


def depths_of(df: DataFrame) -> list[int]:
    return sorted(r.depth for r in df.select("depth").distinct().collect())  # a row per depth


def factory(name: str):
    """``module:callable`` as a function that makes a model on a worker."""
    module, _, attribute = name.partition(":")
    return lambda: getattr(import_module(module), attribute)()


def dataset(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    if a.kaggle_json:
        utilities.setup_download_credentials(a.kaggle_json)
    if a.download:
        raise SystemExit("downloads are not part of this package: fetch the archive and pass its path as --input")
    if not storage.exists(spark, a.input):
        print(f"nothing at {a.input}", file=sys.stderr)
        return
    texts = read(spark, a.input)
    made = corpus.halves(texts, replace(s.corpus, num_samples=a.num_samples) if a.num_samples else s.corpus)
    made.write.mode("overwrite").partitionBy("text_type").parquet(f"{a.output}/halves")
    saved = spark.read.parquet(f"{a.output}/halves")
    table = saved.select("text_type", F.array_join("words", " ").alias("text"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.size("words").alias("word_count"))
    for kind in ("human", "ai"):
        export(table.where(F.col("text_type") == kind).drop("text_type"), a, f"{kind}_text")
    if a.create_variations:
        rows = saved.withColumn("text", F.array_join("words", " ")).drop("words")
        corpus.length_variations(rows).write.mode("overwrite").partitionBy("text_type", "target_words").parquet(f"{a.output}/variations")
        cut = spark.read.parquet(f"{a.output}/variations")
        for kind in ("human", "ai"):
            for n in corpus.LENGTHS:
                rows = cut.where((F.col("text_type") == kind) & (F.col("target_words") == n)).drop("text_type", "target_words")
                export(rows, a, f"{'ai_watermarked' if kind == 'ai' else kind}_{n}")


def watermark(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    prompts = spark.read.parquet(f"{a.output}/halves").where("label = 1")
    if a.max_rows:
        prompts = prompts.orderBy("doc_id").limit(a.max_rows)
    if a.generator_path:  # a model that is stepped, or one that generates by itself
        step = hasattr(factory(a.generator_path)(), "step") if a.generator_kind == "auto" else a.generator_kind == "step"
        make = decoding.decoded if step else generation.generated
        work = lambda df: make(df, factory(a.generator_path), a.new_words, s.watermark)
    else:
        work = lambda df: generation.generated(df, lambda: generation.PromptSampler(s.watermark), a.new_words, s.watermark)
    if a.force_restart:
        work(prompts).write.mode("overwrite").parquet(f"{a.output}/watermarked")
    else:
        storage.append_new(prompts, f"{a.output}/watermarked", work, "doc_id")
    export(spark.read.parquet(f"{a.output}/watermarked"), a, "ai_watermark_bits")


def paraphrase(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    settings = replace(s.paraphrase, iterations=a.iterations or s.paraphrase.iterations)
    texts = spark.read.parquet(f"{a.output}/halves")
    if a.text_type != "both":
        texts = texts.where(F.col("text_type") == a.text_type)
    if a.model_path:  # goes on where an earlier run stopped
        table = texts.select("doc_id", "text_type", "label", F.array_join("words", " ").alias("text"))
        path = f"{a.output}/rounds"
        if a.force_restart:  # what is there is replaced by the originals, whose rounds are then missing
            first = table.withColumns({"word_count": functions.word_count(F.col("text")), "depth": F.lit(0)})
            first.write.mode("overwrite").partitionBy("text_type", "depth").parquet(path)
        deep = paraphrasing.resumed_rounds(table, path, factory(a.model_path), settings, a.batch_size)
        deep = deep if a.text_type == "both" else deep.where(F.col("text_type") == a.text_type)
        export(paraphrasing.wide_texts(deep, settings.iterations), a, f"{a.text_type}_paraphrased")
        deep = deep.withColumn("words", F.split("text", " ")).drop("text", "word_count")
    else:
        deep = paraphrasing.rounds(texts, settings)
    deep.write.mode("overwrite").partitionBy("text_type", "depth").parquet(f"{a.output}/depths")


def detect(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    """Scores what is not scored yet, or with --force-restart all."""
    key, path = ["doc_id", "text_type", "depth"], f"{a.output}/detected"

    def work(df: DataFrame) -> DataFrame:
        if a.tokenizer:
            rows = subwords.tried(df.withColumn("_joined", F.array_join("words", " ")).drop("words"), factory(a.tokenizer), "_joined").drop("_joined")
        else:
            rows = df.withColumnRenamed("words", "tokens").withColumn("error", F.lit(None).cast("string"))
        rows = detection.scored(rows, s.watermark, "tokens").drop("tokens")
        return rows.withColumn("bits", F.array_join(F.col("bits").cast("array<string>"), ""))

    todo = spark.read.parquet(f"{a.output}/depths")
    if a.text_type != "both":
        todo = todo.where(F.col("text_type") == a.text_type)
    if a.force_restart:
        work(todo).write.mode("overwrite").partitionBy("text_type", "depth").parquet(path)
    else:
        storage.append_new(todo, path, work, key, ("text_type", "depth"))
    found = spark.read.parquet(path)
    columns = found.withColumn("watermark_bits", F.when(F.col("error").isNotNull(), "ERROR").otherwise(windows.literal(F.col("bits")))).withColumnRenamed("num_green_tokens", "green_token_count")
    for k in depths_of(found) if a.csv else []:
        for kind, name in (("ai", "AI"), ("human", "Human")):
            export(columns.where((F.col("depth") == k) & (F.col("text_type") == kind)).select("doc_id", *detection.FILE_COLUMNS), a, f"{name}_D{k}")


def combine(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    found = spark.read.parquet(f"{a.output}/detected")
    ids = reshape.sequential_ids(found.where("depth = 0").select("doc_id", "text_type", "label")).drop("label")
    found.join(ids, ["doc_id", "text_type"]).write.mode("overwrite").partitionBy("depth").parquet(f"{a.output}/combined")
    made = spark.read.parquet(f"{a.output}/combined")
    for k in depths_of(made) if a.csv else []:
        export(made.where(F.col("depth") == k).select("id", F.col("bits").alias("0_1_sequence"), "z_score", "label"), a, f"combined_D{k}")


def read_combined(spark: SparkSession, folder: str, depths: list[int]) -> DataFrame:
    """(depth, id, label, z_score, bits) of exported ``combined_D{k}`` files, as the later steps take them."""
    schema = "id bigint, `0_1_sequence` string, z_score double, label int"
    parts = [storage.read_csv(spark, f"{folder}/combined_D{k}.csv", schema).withColumn("depth", F.lit(k)) for k in depths]
    return reshape.merged(parts).select("depth", "id", "label", "z_score", F.coalesce(F.col("0_1_sequence"), F.lit("")).alias("bits"))


def rolling(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    chosen = replace(s.windows, size=a.window_size or s.windows.size, stride=a.stride or s.windows.stride, mode=a.mode or s.windows.mode)
    rows = spark.read.parquet(f"{a.output}/combined").select("depth", "id", "label", "z_score", "bits")
    wins = windows.figures(rows.drop("z_score"), chosen, s.watermark.gamma)
    wins.write.mode("overwrite").partitionBy("depth").parquet(f"{a.output}/windows")
    windows.rolling(rows, chosen, s.watermark.gamma).write.mode("overwrite").partitionBy("depth").parquet(f"{a.output}/rolling")
    saved, static = spark.read.parquet(f"{a.output}/windows"), spark.read.parquet(f"{a.output}/rolling")
    for k in depths_of(static) if a.csv else []:
        here = saved.where(F.col("depth") == k)
        n = (here.agg(F.max("win_idx")).first()[0] or 0) + 1
        export(static.where(F.col("depth") == k).drop("depth").join(windows.wide(here, n, "id"), "id", "left"), a, f"rolling_D{k}")


def pss(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    wins, static = spark.read.parquet(f"{a.output}/windows"), spark.read.parquet(f"{a.output}/rolling")
    there = depths_of(wins)
    results = []
    for position, (name, depths) in enumerate(s.experiments or EXPERIMENTS):
        depths = tuple(d for d in depths if d in there)
        if len(depths) < 2:
            continue
        chosen = wins.where(F.col("depth").isin(*depths))
        n = stability.common_windows(chosen).first().n_windows
        pss = stability.matrix(chosen.where(F.col("win_idx") < n), [(name, depths)])
        own = stability.features(pss, static.where(F.col("depth") == depths[0]), n, s.static_features or windows.STATIC)
        table = stability.split(storage.stored(own, "features"), s.classifier)
        judged = stability.classified(storage.stored(table, "split"), s.classifier)
        results.append(judged.select(F.lit(position).alias("position"), F.lit(name).alias("experiment"), "label", "prediction", "probability"))
    if results:
        judged = storage.stored(reshape.merged(results), "judged")  # all experiments are judged in one pass
        by = ("position", "experiment")
        points = metrics.operating_points(metrics.roc_curves(judged, "probability", *by), *by).select("position", "auc")
        found = metrics.rates(metrics.cells(judged, *by)).join(points, "position")  # a row per experiment
        save(metrics.formatted(found.orderBy("position")), f"{a.output}/results", csv=True)
        print(metrics.summarised(spark.read.options(header="true", inferSchema="true").csv(f"{a.output}/results")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verdigris", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name, help=text)
        c.add_argument("--output", "--output-dir", "--results-dir", required=True, help="folder of the tables of all steps")
        c.add_argument("--csv", action="store_true", help="export each step's result as CSV, too")
        c.add_argument("--exp-config"), c.add_argument("--model-config")
        for flag, more in options:
            c.add_argument(flag, **more)

    number, flag = {"type": int, "default": 0}, {"action": "store_true"}
    cut = [("--input", {"required": True}), ("--num-samples", number), ("--create-variations", flag), ("--download", flag), ("--kaggle-json", {"default": None})]
    again = ("--force-restart", flag)
    mark = [("--max-rows", number), ("--new-words", {"type": int, "default": 200})]
    model = {"default": None, "dest": "generator_path", "help": "module:callable that makes a generator or a model that is stepped; without it a stand-in"}
    made = ("--generator-kind", {"choices": ("auto", "step", "text"), "default": "auto", "help": "auto loads the model once on the driver to see"})
    kind = ("--text-type", {"choices": ("human", "ai", "both"), "default": "both"})
    para = [("--iterations", number), ("--model-path", {"default": None, "help": "module:callable that makes a paraphraser; without it a stand-in"}), ("--batch-size", {"type": int, "default": 10})]
    look = [("--window-size", number), ("--stride", number), ("--mode", {"choices": ("clean", "literal")})]
    command("dataset", "cut samples from a corpus", *cut)
    command("watermark", "continue the machine side with a watermark", *mark, again, ("--model-path", model), made)
    command("paraphrase", "rounds of paraphrase", *para, kind, again)
    tokens = ("--tokenizer", {"default": None, "help": "module:callable that makes a function from texts to tokens or ids; without it words"})
    command("detect", "score all depths", kind, again, tokens)
    command("analyze", "windows, stability, classifier", *look, ("--skip-combine", flag), ("--skip-rolling", flag))
    command("pipeline", "several steps", *cut, *mark, ("--generator-path", model), made, *para, kind, again, tokens, *look, ("--steps", {"nargs": "+", "choices": ("all", *STEPS), "default": ["all"]}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    settings = load(*[c for c in (a.exp_config, a.model_config) if c])
    run = {"dataset": dataset, "watermark": watermark, "paraphrase": paraphrase, "detect": detect, "combine": combine, "rolling": rolling, "pss": pss}
    if a.command == "analyze":
        steps = [x for x in ("combine", "rolling", "pss") if not (x == "combine" and a.skip_combine or x == "rolling" and a.skip_rolling)]
    elif a.command == "pipeline":
        steps = list(STEPS) if "all" in a.steps else [x for x in STEPS if x in a.steps]
    else:
        steps = [a.command]
    spark = session()
    for step in steps:
        run[step](spark, a, settings)


if __name__ == "__main__":
    main()
