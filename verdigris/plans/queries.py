"""The queries by which the operators are checked, each over its whole tables."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.config import EXPERIMENTS, SMALL, WINDOW_PRESETS, Corpus, Windows
from verdigris.functions import scores as S
from verdigris.functions import text as T
from verdigris.operators import corpus, decoding, detection, generation, metrics, paraphrasing, reshape, stability, subwords, vocabulary, windows
from verdigris.sources.storage import dealt, remaining, spread, stored

CUT, MARK, PARA, WIN = SMALL.corpus, SMALL.watermark, SMALL.paraphrase, SMALL.windows
#: Windows of each sequence under SMALL: 60 words give 59 bits.
N_WINDOWS = 9
LENGTHS = (200, 100, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, *columns: str, deal=spread) -> DataFrame:
    return deal(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def halves(spark: SparkSession, sf_dir: str, deal=spread) -> DataFrame:
    return corpus.halves(docs(spark, sf_dir, deal=deal), CUT)


def whole(spark: SparkSession, sf_dir: str, deal=spread) -> DataFrame:
    """(doc_id, text_type, label, words) of all documents with all their words; a null text has none."""
    words = F.coalesce(T.words(F.col("text")), F.array().cast("array<string>"))
    return docs(spark, sf_dir, deal=deal).select("doc_id", F.lit("document").alias("text_type"), F.lit(0).alias("label"), words.alias("words"))


def whole_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``halves`` of all words of all documents."""
    return corpus.whole_halves(docs(spark, sf_dir))


def detected(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_type, label, depth, bits string, counts, z) of all depths."""
    return detection.scored_rounds(texts or halves(spark, sf_dir), PARA, MARK)


def combined(spark: SparkSession, sf_dir: str, texts=halves) -> DataFrame:
    """``detected`` with the ids that serve all depths."""
    texts = stored(texts(spark, sf_dir), "halves")  # read for the ids and for the bits
    return detected(spark, sf_dir, spread(texts)).join(reshape.sequential_ids(texts).drop("label"), ["doc_id", "text_type"])


def all_windows(spark: SparkSession, sf_dir: str, texts=halves, win: Windows = WIN) -> DataFrame:
    return windows.figures(combined(spark, sf_dir, texts).select("depth", "id", "label", "bits"), win, MARK.gamma)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, with no negative zero, so that engines can be compared.

    Nine places first: values that lie halfway then round alike whatever the last bit.
    """
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: S.places(S.places(c, 9), 6) for c in names})


# scans and corpus preparation


def scan_pruned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars")


def validate_tables(spark, sf_dir):
    wanted = {"documents": ("doc_id", "text"), "labels": ("doc_id", "quality"), "benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn")}
    return reshape.validated({k: (table(spark, sf_dir, k), v) for k, v in wanted.items()} | {"missing_table": (None, ())})


def viable_docs(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.coalesce(corpus.viable(d, CUT), F.lit(False)).alias("viable"))


def word_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


def word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def extract_words(spark, sf_dir):
    rows = corpus.extracted(docs(spark, sf_dir), CUT)
    return rows.select("doc_id", F.array_join("words", " ").alias("words"), F.size("words").cast("bigint").alias("n_words"), "success")


def sample_docs(spark, sf_dir):
    rows = corpus.samples(docs(spark, sf_dir), Corpus(CUT.skip_lines, CUT.words_per_sample, 50))
    return rows.select("doc_id", F.array_join("words", " ").alias("sample"))


def human_ai_split(spark, sf_dir):
    return halves(spark, sf_dir).select("doc_id", "text_type", F.array_join("words", " ").alias("text"), F.size("words").cast("bigint").alias("word_count"))


def create_dataset(spark, sf_dir):
    return corpus.dataset(docs(spark, sf_dir), CUT)


def trim_words(spark, sf_dir):
    return corpus.with_trimmed(docs(spark, sf_dir), 100).select("doc_id", "text_cleaned", "new_word_count")


def length_variations(spark, sf_dir):
    return corpus.length_variations(docs(spark, sf_dir), LENGTHS).select("doc_id", F.col("target_words").cast("bigint").alias("target_words"), "text_cleaned", "new_word_count")


def text_md5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


# vocabulary and watermark


def vocab(spark, sf_dir, texts=halves):
    return vocabulary.vocabulary(texts(spark, sf_dir))


def token_ids(spark, sf_dir, texts=halves):
    words = texts(spark, sf_dir)
    rows = vocabulary.token_ids(words, vocabulary.vocabulary(words))
    return rows.select("doc_id", "text_type", F.col("pos").cast("bigint").alias("pos"), "tok_id")


def symbols(spark, sf_dir):
    """A small vocabulary: the language and source marks of the documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("token")).union(d.select("source")).where("token IS NOT NULL").distinct()


def greenlist_rank(spark, sf_dir):
    tokens = stored(symbols(spark, sf_dir), "symbols")
    return vocabulary.greenlists(tokens.select(F.col("token").alias("prev")), tokens, MARK)


def greenlist_words(spark, sf_dir):
    """The exact lists of the language marks over the vocabulary of all documents."""
    tokens = stored(vocabulary.vocabulary(whole(spark, sf_dir)).select("token"), "tokens")
    return vocabulary.greenlists(table(spark, sf_dir, "documents").select(F.col("lang").alias("prev")), tokens, MARK)


def greenlist_exact(spark, sf_dir, texts=halves):
    """For each pair of neighbours: the place of the second word in the permutation that the first one seeds, and whether it is on the exact list."""
    words = texts(spark, sf_dir)
    tokens = stored(vocabulary.vocabulary(words), "vocabulary")
    size = tokens.count()
    pairs = vocabulary.corpus_bigrams(words).join(tokens.select("token", "tok_id"), "token")
    placed = pairs.select("prev", "token", "tok_id", vocabulary.exact_place(F.col("prev"), F.col("tok_id"), size, MARK).alias("place"))
    return placed.withColumn("green", vocabulary.on_list(F.col("place"), size, MARK))


def greenlist_exact_lists(spark, sf_dir):
    """The exact lists of the language marks over the vocabulary of all documents."""
    tokens = stored(vocabulary.vocabulary(whole(spark, sf_dir)), "vocabulary")
    return vocabulary.exact_lists(table(spark, sf_dir, "documents").select(F.col("lang").alias("prev")), tokens, MARK)


def greenlist_hash(spark, sf_dir, texts=halves):
    pairs = vocabulary.corpus_bigrams(texts(spark, sf_dir))
    u = S.uniform(F.lit(MARK.hash_key), F.col("prev"), F.col("token"))
    return rounded(pairs.select("prev", "token", u.alias("u"), S.is_green(F.col("prev"), F.col("token"), MARK.hash_key, MARK.gamma).alias("green")))


def bias_logits(spark, sf_dir, texts=halves):
    return rounded(vocabulary.biased_logits(vocabulary.corpus_bigrams(texts(spark, sf_dir)), MARK))


def bigram_counts(spark, sf_dir, texts=halves):
    return vocabulary.bigrams(texts(spark, sf_dir, deal=lambda d: dealt(d, "doc_id")))


def watermark_generate(spark, sf_dir):
    return generation.generated(halves(spark, sf_dir).where("label = 1"), lambda: generation.PromptSampler(MARK), 60, MARK)


def watermark_decode(spark, sf_dir):
    """The machine side continued by a model of the whole corpus, all rows of a batch a step at a time."""
    model = decoding.corpus_model(whole(spark, sf_dir))
    return decoding.decoded(halves(spark, sf_dir).where("label = 1"), lambda: model, 60, MARK)


def resume_antijoin(spark, sf_dir):
    todo = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return remaining(todo, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


# detection


def _scores(rows: DataFrame, *ids: str) -> DataFrame:
    return rounded(rows.select(*ids, "num_tokens_scored", "num_green_tokens", "green_fraction", "z_score"))


def detect_text(spark, sf_dir, texts=halves):
    rows = detection.scored(texts(spark, sf_dir), MARK)
    bits = F.array_join(F.col("bits").cast("array<string>"), "").alias("bits")
    return rounded(rows.select("doc_id", "text_type", bits, "num_tokens_scored", "num_green_tokens", "green_fraction", "z_score"))


def green_bits(spark, sf_dir, texts=halves):
    return detection.exploded_bits(texts(spark, sf_dir), MARK, "doc_id", "text_type")


def bits_csv(spark, sf_dir, texts=halves):
    return detection.csv_bits(detection.scored(texts(spark, sf_dir), MARK)).select("doc_id", "text_type", "watermark_bits")


def detection_file(spark, sf_dir):
    """The documents' detection file; null texts have the bits ``ERROR``. The text column is found by its name."""
    rows = detection.detection_file(docs(spark, sf_dir), MARK)
    return rounded(rows.select("doc_id", *detection.FILE_COLUMNS))


def score_sequence(spark, sf_dir, texts=halves):
    return _scores(detection.scored(texts(spark, sf_dir), MARK), "doc_id", "text_type")


def detect_docs(spark, sf_dir):
    rows = detection.predicted(detection.scored_texts(docs(spark, sf_dir), MARK, "text"), MARK, threshold=1.5)
    return rounded(rows.select("doc_id", "num_tokens_scored", "num_green_tokens", "green_fraction", "z_score", "prediction"))


def score_unique_bigrams(spark, sf_dir, texts=halves):
    return rounded(detection.unique_bigram_scores(texts(spark, sf_dir), MARK).select("doc_id", "text_type", "num_tokens_scored", "num_green_tokens", "z_score"))


def z_score(spark, sf_dir):
    """Of the digits in a text against its length: the statistic by itself."""
    d = docs(spark, sf_dir)
    n, k = F.length(F.coalesce("text", F.lit(""))), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^aeiou]", ""))
    return rounded(d.select("doc_id", k.cast("bigint").alias("k"), n.cast("bigint").alias("t"), S.z_score(k, n, MARK.gamma).alias("z")))


def p_value(spark, sf_dir, texts=halves):
    rows = detection.scored(texts(spark, sf_dir), MARK)
    return rounded(rows.select("doc_id", "text_type", "z_score", S.p_value("z_score").alias("p_value")))


def detect_prediction(spark, sf_dir, texts=halves):
    rows = detection.predicted(detection.scored(texts(spark, sf_dir), MARK), MARK, threshold=1.0)
    return rounded(rows.select("doc_id", "text_type", "z_score", "prediction"))


def detect_all_depths(spark, sf_dir, texts=halves):
    return rounded(detected(spark, sf_dir, texts(spark, sf_dir)).select("doc_id", "text_type", "depth", "bits", "z_score", "green_fraction", F.col("num_green_tokens").alias("green_token_count")))


def detection_summary(spark, sf_dir, texts=halves):
    return rounded(detection.summary(detected(spark, sf_dir, texts(spark, sf_dir)), "text_type", "depth"))


def _subwords(spark, sf_dir) -> DataFrame:
    """All documents with their subword tokens, by the corpus's own pieces."""
    texts = whole(spark, sf_dir)
    return subwords.segmented(texts, subwords.corpus_pieces(texts))


def token_ids_subword(spark, sf_dir):
    return _subwords(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("pos", "tok_id"))


def detect_subword(spark, sf_dir):
    return _scores(detection.scored(_subwords(spark, sf_dir), MARK, "tokens"), "doc_id")


# paraphrase


def paraphrase_prompt(spark, sf_dir):
    least, _, _ = T.budget(T.word_count(F.col("text")), PARA.tolerance)
    return docs(spark, sf_dir).select("doc_id", T.paraphrase_prompt(F.col("text"), least).alias("prompt"))


def clean_output(spark, sf_dir):
    marked = F.concat(F.when(F.pmod("turn", F.lit(2)) == 0, "OutPut: ").otherwise(" "), F.col("text"), F.lit(" \n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cleaned_output(marked).alias("cleaned"))


def paraphrase_budget(spark, sf_dir):
    n = T.word_count(F.col("text"))
    least, most, tokens = T.budget(n, PARA.tolerance)
    return docs(spark, sf_dir).select("doc_id", n.alias("target"), least.alias("min_words"), most.alias("max_words"), tokens.alias("max_tokens"))


def paraphrase_rounds(spark, sf_dir, texts=halves):
    return paraphrasing.round_texts(texts(spark, sf_dir), PARA).select("doc_id", "text_type", "depth", "text")


def words_per_round(spark, sf_dir, texts=halves):
    return rounded(paraphrasing.words_per_round(paraphrasing.round_texts(texts(spark, sf_dir), PARA)))


def resume_point(spark, sf_dir, texts=halves):
    """Where a job would go on whose third round stopped at the first unlabelled document."""
    wide = paraphrasing.wide_rounds(texts(spark, sf_dir).where("text_type = 'ai'"), PARA)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l")).distinct()
    rows = wide.join(labelled, F.col("doc_id") == F.col("l"), "left")
    rows = rows.withColumn("paraphrase_iter_3", F.when(F.col("l").isNotNull(), F.col("paraphrase_iter_3")))
    return paraphrasing.resume_point(rows, PARA.iterations)


# reshaping


def unpivot_depths(spark, sf_dir, texts=halves):
    return reshape.unpivoted(paraphrasing.wide_rounds(texts(spark, sf_dir), PARA), PARA.iterations)


def combine_detections(spark, sf_dir, texts=halves):
    rows = detected(spark, sf_dir, texts(spark, sf_dir).where("text_type = 'ai'")).select("doc_id", "depth", "z_score", "num_green_tokens")
    rows = stored(rows, "detections")  # made once, read for each depth
    parts = [rows.where(F.col("depth") == k).drop("depth") for k in range(PARA.iterations + 1)]
    return rounded(reshape.tagged(parts, "ai"))


def combine_labeled(spark, sf_dir, texts=halves):
    rows = detected(spark, sf_dir, texts(spark, sf_dir)).select("doc_id", "text_type", "depth", F.col("bits").alias("0_1_sequence"), "z_score")
    rows = stored(rows, "detections")  # made once, read for each side and for the depths that both have
    return rounded(reshape.labelled(rows.where("text_type = 'ai'").drop("text_type"), rows.where("text_type = 'human'").drop("text_type")))


def sequential_id(spark, sf_dir, texts=halves):
    return reshape.sequential_ids(texts(spark, sf_dir))


def validate_counts(spark, sf_dir, texts=halves):
    return reshape.counts_by_depth(detected(spark, sf_dir, texts(spark, sf_dir)).select("depth", "label"))


def merge_outer(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", "quality")
    b = docs(spark, sf_dir, "n_chars").drop("text")
    return reshape.merged([b, a, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("quality"))], "doc_id")


def merge_concat(spark, sf_dir):
    a = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return reshape.merged([a, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("digest"))])


# windows


def window_rows(spark, sf_dir):
    return windows.windows(combined(spark, sf_dir).select("depth", "id", "bits"), WIN).select("depth", "id", "win_idx", "win_start", "win_end", "win")


def _literal(rows: DataFrame, win: Windows = WIN) -> DataFrame:
    from dataclasses import replace

    return windows.figures(rows, replace(win, mode="literal"), MARK.gamma)


def window_literal(spark, sf_dir):
    """The same over comma-joined text, as files hold it, at depth 0."""
    rows = combined(spark, sf_dir).where("depth = 0").select("id", "bits")
    return rounded(_literal(rows).select("id", "win_idx", "win_start", "win_end", "z", "run", "freq"))


def window_literal_depths(spark, sf_dir, texts=halves, win=WIN):
    """``window_literal`` at all depths."""
    rows = combined(spark, sf_dir, texts).select("depth", "id", "bits")
    return rounded(_literal(rows, win).select("depth", "id", "win_idx", "win_start", "win_end", "z", "run", "freq"))


def window_z(spark, sf_dir):
    return rounded(all_windows(spark, sf_dir).select("depth", "id", "win_idx", "z"))


def window_runs(spark, sf_dir):
    return all_windows(spark, sf_dir).select("depth", "id", "win_idx", "run", "freq")


def window_stats(spark, sf_dir):
    names = [c for c in windows.STATIC if "autocorr" not in c]
    return rounded(_rolling(combined(spark, sf_dir).where("length(bits) > 0").select("depth", "id", "bits")).select("depth", "id", *names))


def autocorr(spark, sf_dir):
    return rounded(_rolling(combined(spark, sf_dir).where("length(bits) > 0").select("depth", "id", "bits")).select("depth", "id", "z_autocorr_lag1", "z_autocorr_lag2"))


def _bits(spark, sf_dir, texts=halves) -> DataFrame:
    """The bits of all depths, stored: what follows reads them more than once."""
    return stored(combined(spark, sf_dir, texts).select("depth", "id", "label", "z_score", "bits"), "bits")


def _rolling(base: DataFrame, win: Windows = WIN) -> DataFrame:
    return windows.rolling(base, win, MARK.gamma)


def _whole_bits(spark, sf_dir) -> DataFrame:
    """(doc_id, z_score, bits) of all words of all documents, stored: what follows reads them more than once."""
    rows = detection.scored(whole(spark, sf_dir), MARK)
    return stored(rows.select("doc_id", "z_score", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits")), "whole-bits")


def windows_docs(spark, sf_dir):
    """Windows of the default size over whole documents."""
    rows = windows.features(windows.windows(_whole_bits(spark, sf_dir).drop("z_score"), Windows()), MARK.gamma)
    return rounded(rows.select("doc_id", "win_idx", "win_start", "win_end", "win", "z", "run", "freq"))


#: Bits of a chunk row, less than a window, so that a window takes several.
CHUNK = 37


def windows_chunked(spark, sf_dir):
    """``windows_docs`` of sequences that come in chunk rows, as those too long for a row do."""
    rows = _whole_bits(spark, sf_dir).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.length("bits") / CHUNK).cast("int"))))
    chunks = rows.select("doc_id", "chunk", F.substring(F.col("bits"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("bits"))
    return rounded(windows.windows_of_chunks(chunks, Windows(), MARK.gamma, "doc_id", tile=100))


def rolling_presets(spark, sf_dir):
    """The figures of whole documents, to four places, under each preset of window size and stride."""
    bits = _whole_bits(spark, sf_dir)
    parts = [windows.rolling(bits.withColumn("preset", F.lit(name)), Windows(*shape), MARK.gamma) for name, shape in WINDOW_PRESETS.items()]
    return rounded(reduce(DataFrame.unionByName, parts)).withColumns({c: S.places(c, 4) for c in windows.STATIC})


def rolling_features(spark, sf_dir, texts=halves, win=WIN):
    return rounded(_rolling(_bits(spark, sf_dir, texts), win))


def rolling_wide(spark, sf_dir):
    return rounded(windows.wide(all_windows(spark, sf_dir), N_WINDOWS, "depth", "id"))


# stability and classification


def common_windows(spark, sf_dir, texts=halves, win=WIN):
    scores = windows.local_scores(detected(spark, sf_dir, texts(spark, sf_dir)).where("depth BETWEEN 1 AND 8").select("depth", "bits"), win, MARK.gamma)
    return stability.common_windows_of_arrays(scores).select(F.col("n_windows").cast("bigint").alias("n_windows"))


#: The experiment that takes all depths.
ALL_DEPTHS = max(EXPERIMENTS, key=lambda e: len(e[1]))


def _stability(spark, sf_dir, texts=halves, win: Windows = WIN) -> DataFrame:
    """(experiment, doc_id, text_type, win_idx, pss), made of arrays: no window is a row before it has its figure."""
    scores = windows.local_scores(detected(spark, sf_dir, texts(spark, sf_dir)).select("doc_id", "text_type", "depth", "bits"), win, MARK.gamma)
    return stability.matrix_of_arrays(scores, ("doc_id", "text_type"))


def pss_matrix(spark, sf_dir, texts=halves, win=WIN):
    texts = stored(texts(spark, sf_dir), "halves")  # read for the ids and for the scores
    scores = windows.local_scores(detected(spark, sf_dir, spread(texts)).select("doc_id", "text_type", "depth", "bits"), win, MARK.gamma)
    pss = stability.matrix_of_arrays(scores, ("doc_id", "text_type"), [ALL_DEPTHS])
    return rounded(pss.join(reshape.sequential_ids(texts).drop("label"), ["doc_id", "text_type"]).select("id", "win_idx", "pss"))


def pss_sweep(spark, sf_dir, texts=halves, win=WIN):
    pss = _stability(spark, sf_dir, texts, win)
    return rounded(pss.groupBy("experiment", "win_idx").agg(F.count("*").alias("n"), F.avg("pss").alias("mean_pss"), F.max("pss").alias("max_pss")))


def _features(spark, sf_dir) -> DataFrame:
    bits = _bits(spark, sf_dir)
    pss = stability.matrix_of_arrays(windows.local_scores(bits.select("id", "depth", "bits"), WIN, MARK.gamma), ("id",), [ALL_DEPTHS])
    return stability.features(pss, _rolling(bits.where("depth = 1")), N_WINDOWS)


def pss_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir))


def stratified_split(spark, sf_dir):
    return stability.split(reshape.sequential_ids(halves(spark, sf_dir)).select("id", "label"), SMALL.classifier)


def pss_classify(spark, sf_dir):
    from dataclasses import replace

    return stability.classified(stored(stability.split(stored(_features(spark, sf_dir), "features"), SMALL.classifier), "split"), replace(SMALL.classifier, trees=10))


def _judged(spark, sf_dir) -> DataFrame:
    """Labels as truth; a document is predicted good if it has at least fifty words."""
    d = docs(spark, sf_dir).select("doc_id", (T.word_count(F.col("text")) >= 50).cast("int").alias("prediction"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic").join(d, "doc_id")


def auc(spark, sf_dir, texts=halves):
    """AUC of the score of the texts as they are; they need no round of paraphrase."""
    return rounded(metrics.roc_auc(detection.scored(texts(spark, sf_dir), MARK).select("label", "z_score"), "z_score"))


def auc_by_depth(spark, sf_dir, texts=halves):
    """AUC of the score at every depth, and the threshold at five percent false positives, in one pass."""
    return rounded(metrics.operating_points(metrics.roc_curves(detected(spark, sf_dir, texts(spark, sf_dir)).select("depth", "label", "z_score"), "z_score", "depth"), "depth"))


def auc_by_experiment(spark, sf_dir, texts=halves, win=WIN):
    """The same for every experiment, with a text's mean spread as its score."""
    scores = windows.local_scores(detected(spark, sf_dir, texts(spark, sf_dir)).select("doc_id", "text_type", "label", "depth", "bits"), win, MARK.gamma)
    texts = rounded(stability.summary_of_arrays(scores, ("doc_id", "text_type", "label")))  # ties of scores are then ties
    return rounded(metrics.operating_points(metrics.roc_curves(texts, "mean_pss", "experiment"), "experiment"))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir))


def prf(spark, sf_dir):
    return metrics.rates(metrics.cells(_judged(spark, sf_dir))).select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def metrics_all(spark, sf_dir):
    return rounded(metrics.rates(metrics.cells(_judged(spark, sf_dir), "toxic")))


def best_experiment(spark, sf_dir, texts=halves, win=WIN):
    pss = _stability(spark, sf_dir, texts, win).groupBy("experiment").agg(F.round(F.avg("pss"), 6).alias("mean_pss"))
    order = spark.createDataFrame([(n, k) for k, (n, _) in enumerate(EXPERIMENTS)], "experiment string, position int")
    return metrics.best(pss.join(F.broadcast(order), "experiment"), "mean_pss")


_RENAMED = {"window_rows": "windows", "metrics_all": "metrics"}
QUERIES = {
    _RENAMED.get(f.__name__, f.__name__): f
    for f in (
        scan_pruned, validate_tables, viable_docs, word_tokens, word_count, extract_words, sample_docs, human_ai_split, create_dataset, trim_words,
        length_variations, text_md5, vocab, token_ids, greenlist_rank, greenlist_words, greenlist_exact, greenlist_exact_lists, greenlist_hash, bias_logits, bigram_counts, watermark_generate, watermark_decode, resume_antijoin,
        detect_text, green_bits, bits_csv, detection_file, score_sequence, detect_docs, score_unique_bigrams, z_score, p_value, detect_prediction, detect_all_depths,
        detection_summary, token_ids_subword, detect_subword, paraphrase_prompt, clean_output, paraphrase_budget, paraphrase_rounds, words_per_round, resume_point, unpivot_depths,
        combine_detections, combine_labeled, sequential_id, validate_counts, merge_outer, merge_concat, window_rows, window_literal, window_literal_depths, window_z, window_runs,
        window_stats, autocorr, windows_docs, windows_chunked, rolling_presets, rolling_features, rolling_wide, common_windows, pss_matrix, pss_sweep, pss_features, stratified_split, pss_classify, auc, auc_by_depth, auc_by_experiment,
        confusion_matrix, prf, metrics_all, best_experiment,
    )
}
#: Queries over sample halves whose operators take any text; NAME_docs runs them over whole documents (``detect_docs`` has the scores and predictions).
WHOLE = (
    "vocab", "token_ids", "greenlist_exact", "greenlist_hash", "bias_logits", "bigram_counts", "green_bits", "bits_csv", "score_unique_bigrams", "p_value", "detect_text", "score_sequence", "detect_prediction",
    "paraphrase_rounds", "words_per_round", "detect_all_depths", "detection_summary",
)
QUERIES |= {f"{name}_docs": partial(QUERIES[name], texts=whole) for name in WHOLE}
#: Queries that compare two sides; NAME_docs takes both halves of all words of all documents, and windows of the default size.
HALVED = ("unpivot_depths", "combine_detections", "combine_labeled", "validate_counts", "resume_point", "sequential_id", "auc", "auc_by_depth")
HALVED_WINDOWS = ("window_literal_depths", "rolling_features", "common_windows", "pss_matrix", "pss_sweep", "auc_by_experiment", "best_experiment")
QUERIES |= {f"{name}_docs": partial(QUERIES[name], texts=whole_halves) for name in HALVED}
QUERIES |= {f"{name}_docs": partial(QUERIES[name], texts=whole_halves, win=Windows()) for name in HALVED_WINDOWS}
