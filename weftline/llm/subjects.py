"""Subject areas of messages by propagating labels over the graph of sentences that share terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.messages import message_sentences, sentence_words
from weftline.session import discard, written, written_by

#: A sentence that this share of all threads (four at least) have word for word is a set phrase; copies of a message count once.
PHRASE_SHARE = 0.007
#: Terms are words that this share of the documents (three at least) use in other sentences.
TERM_SHARE = 0.0005
#: A term counts for an area from this share of its sentences on (while labels spread, and in the end), and if the
#: odds of the area among its labelled sentences are so many times those in its language.
SPREADING_PURITY, PURITY, ODDS, SMOOTHING = 0.15, 0.3, 3.0, 3
#: A sentence is about the best area from this sum of its terms' shares on (while labels spread, and in the end),
#: unless the next best comes nearer than RIVAL times that.
SPREADING_SUPPORT, SUPPORT, RIVAL = 0.4, 0.6, 0.8
#: Sentences on an area that make a message one about it.
SENTENCES = 3
#: Tables of up to so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _sized(df: DataFrame) -> DataFrame:
    """A small written table with a broadcast hint, if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, ids, langs, words, first, digests, threads = [], [], [], [], [], [], []
        for row, doc_id, text, lang, thread in zip(pdf["row"].tolist(), pdf["doc_id"], pdf["text"], pdf["lang"], pdf["thread"], strict=True):
            seen = set()
            keys = [key for sentence in message_sentences(text) if (key := sentence_words(sentence))]
            digest = hashlib.sha256("\n".join(keys).encode()).hexdigest()
            for key in keys:
                rows.append(row)
                ids.append(doc_id)
                langs.append(lang)
                words.append(key)
                first.append(key not in seen)
                seen.add(key)
                digests.append(digest)
                threads.append(thread or digest)
        yield pd.DataFrame({"row": pd.Series(rows, dtype="int64"), "doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype), "lang": pd.Series(langs, dtype=object), "words": pd.Series(words, dtype=object), "first": pd.Series(first, dtype=bool), "digest": pd.Series(digests, dtype=object), "thread": pd.Series(threads, dtype=object)})


def thread_root(message_id: str, in_reply_to: str, ref_ids: str) -> Column:
    """The message that a thread began with: the first reference, else what is answered (a message doesn't answer itself), else the message."""
    none = F.lit(None).cast("string")
    named = lambda c: F.when(F.trim(c) != "", F.trim(c)).otherwise(none)
    first = named(F.regexp_extract(F.coalesce(ref_ids, F.lit("")), r"(<[^<>\s]+>)", 1))
    other = named(F.when(~F.col(in_reply_to).eqNullSafe(F.col(message_id)), F.col(in_reply_to)))
    return F.coalesce(first, other, named(F.col(message_id)))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``trusted``: areas that most of a document's annotators gave; empty where none did."""
    votes = labels.where("doc_id is not null").groupBy("doc_id", "area_code").agg(F.countDistinct("annotator").alias("n"))
    voters = labels.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("annotator").alias("of"))
    good = F.when((F.col("area_code") != "none") & (F.col("n") * 2 > F.col("of")), F.col("area_code"))
    return votes.join(voters, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set(good)).alias("trusted"))


def _weights(counted: DataFrame, least: float) -> DataFrame:
    """``term``, ``area``, ``weight`` of the terms that stand for an area.

    ``counted`` has ``term``, ``lang`` (the term's language), ``area``, ``n``
    (its sentences on the area), ``labelled`` (its sentences on any area) and
    ``of`` (all its sentences); ``least`` is the share asked for. Words that any text of a language has come with
    its areas in the language's own proportions, and so carry none.
    """
    terms = counted.groupBy("term", "lang").agg(F.max("labelled").alias("labelled"))
    whole = terms.groupBy("lang").agg(F.sum("labelled").alias("_of"))
    per_area = counted.groupBy("lang", "area").agg(F.sum("n").alias("_n"))
    base = per_area.join(whole, "lang").select("lang", "area", F.least(F.greatest(F.col("_n") / F.col("_of"), F.lit(0.02)), F.lit(0.95)).alias("base"))
    known = counted.join(_sized(written(base)), ["lang", "area"])
    share = (F.col("n") + SMOOTHING * F.col("base")) / (F.col("labelled") + SMOOTHING)
    odds = lambda p: p / (1 - p)
    purity = (F.col("n") + SMOOTHING * 0.01) / (F.col("of") + SMOOTHING)
    pure = known.where((odds(F.least(share, F.lit(0.999))) >= ODDS * odds(F.col("base"))) & (purity >= least))
    return pure.select("term", "area", purity.alias("weight"))


def _sure(placed: DataFrame, weights: DataFrame, support: float) -> DataFrame:
    """``placed`` with the ``area`` of the sentences whose terms speak for one area clearly enough.

    Nothing is shuffled, as the sentences lie by ``sid`` already.
    """
    scores = placed.select("sid", F.explode("terms").alias("term")).join(_sized(weights), "term").groupBy("sid", "area").agg(F.sum("weight").alias("score"))
    ranked = scores.groupBy("sid").agg(F.max(F.struct("score", "area")).alias("best"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))  # a score per area
    sure = ranked.where((F.col("best.score") >= support) & (F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0)) <= RIVAL * F.col("best.score")))
    return placed.join(sure.select("sid", "best.area"), "sid")


def label_sentences(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", thread: str | None = None,
                    phrase_share: float = PHRASE_SHARE, term_share: float = TERM_SHARE, spread: bool = True) -> DataFrame:
    """``row``, ``doc_id``, ``sid``, ``area`` of the sentences that are about an area.

    ``row`` tells repeated rows of ``documents`` apart. The graph joins
    sentences through the terms they share; it is kept as the incidence of
    sentences and terms, so no pairs of sentences are formed. Edges are
    verified: sentences that ``phrase_share`` of all threads have word for word
    (messages that say the same sentences in the same order are of one thread,
    and so are those of one ``thread``, a column of their root)
    and terms of fewer documents than ``term_share`` are left out, and a term
    carries an area only as far as its sentences agree on it (PURITY), beyond
    what is usual in its language (ODDS): that in which most documents with it
    are, by the first two letters of ``lang``, null being one more.
    Seeds are the majority labels of ``labels``; while labels spread their
    documents stay clamped: no sentence of theirs passes on an area that the
    annotators didn't give. Each round passes areas from terms to sentences and
    back by joins and sums, until each term is passed the same areas as often as in the round before, or in
    any earlier one, between which they would go round for ever. In the end every document keeps all
    areas that its sentences get, the seeds too, as annotators make mistakes.
    Without ``spread`` only what the seeds' terms say is applied.
    """
    language = F.lower(F.substring(F.col(lang), 1, 2)) if lang else F.lit("")
    root = F.col(thread).cast("string") if thread else F.lit(None).cast("string")
    numbered = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(language, F.lit("")).alias("lang"), root.alias("thread")).where("text is not null").withColumn("row", F.monotonically_increasing_id())
    kind = documents.schema[doc_id].dataType.simpleString()
    said = written(numbered.mapInPandas(_extract, f"row long, doc_id {kind}, lang string, words string, first boolean, digest string, thread string").withColumn("sid", F.monotonically_increasing_id()))
    n_documents = documents.count()

    # Copies have one digest and go to the least of their threads, so neither they nor quotations make a sentence a set phrase.
    n_threads = said.groupBy("digest").agg(F.min("thread").alias("thread")).agg(F.countDistinct("thread")).first()[0]
    apart = said.where("first").groupBy("words", "digest").agg(F.min("thread").alias("thread")).groupBy("words").agg(F.countDistinct("thread").alias("n"))
    phrases = written(apart.where(F.col("n") >= max(4, phrase_share * n_threads)).select("words"))
    own = said.join(_sized(phrases), "words", "left_anti")

    split = own.select("row", "doc_id", "lang", "sid", F.array_distinct(F.filter(F.split("words", " "), lambda w: F.length(w) > 2)).alias("terms"))
    counts = split.select("lang", F.explode("terms").alias("term")).groupBy("term", "lang").agg(F.count(F.lit(1)).alias("n"))
    by_term = counts.groupBy("term").agg(F.sum("n").alias("of"), F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    vocabulary = _sized(written(by_term.where(F.col("of") >= max(3, term_share * n_documents))))

    known = _sized(written(trusted_labels(labels)))
    placed = written_by(split.join(known, "doc_id", "left"), "sid")  # no round shuffles it

    # First what the seeds say: each sentence of a labelled document counts for its areas in equal parts.
    of_seeds = placed.where("trusted is not null").select("trusted", F.explode("terms").alias("term")).join(vocabulary.select("term", "lang"), "term")
    seen = of_seeds.groupBy("term", "lang").agg(F.count(F.lit(1)).alias("of"))
    given = of_seeds.select("term", F.explode("trusted").alias("area"), (1 / F.size("trusted")).alias("part")).groupBy("term", "area").agg(F.sum("part").alias("n"))
    weights = written(_weights(given.join(seen, "term").withColumn("labelled", F.col("of")), PURITY))

    passed_before: set[tuple] = set()
    while spread:
        # No sentence of a seed passes on an area that the seed doesn't have.
        passing = _sure(placed, weights, SPREADING_SUPPORT).where("trusted is null or array_contains(trusted, area)")
        agreed = written(passing.select("area", F.explode("terms").alias("term")).groupBy("term", "area").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term"))
        state = tuple(agreed.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("term", "area", "n"))).first())
        stable = state in passed_before
        passed_before.add(state)
        counted = agreed.join(agreed.groupBy("term").agg(F.sum("n").alias("labelled")), "term")
        discard(weights)
        weights = written(_weights(counted, PURITY if stable else SPREADING_PURITY))
        discard(agreed)
        if stable:
            break
    out = written(_sure(placed, weights, SUPPORT).select("row", "doc_id", "sid", "area"))
    for done in (placed, weights, said):
        discard(done)
    return out


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", thread: str | None = None) -> DataFrame:
    """``doc_id``, ``area_code`` of each area that at least SENTENCES sentences of a message are about.

    What is said and what is quoted counts; null, empty and blank texts have no
    areas, nor does anything without seeds or an empty table. Very long texts
    are read whole. Of repeated rows of one ``doc_id``, any may bring in an area,
    which is given once. Other columns are ignored, whatever their names.
    """
    sentences = label_sentences(documents, labels, doc_id, text, lang, thread)
    enough = sentences.groupBy("row", "doc_id", "area").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SENTENCES)
    named = areas.select(F.col("area_code").alias("area")).distinct()
    return enough.join(named, "area").select(F.col("doc_id").alias(doc_id), F.col("area").alias("area_code")).distinct()


def area_shares(documents: DataFrame, found: DataFrame, areas: DataFrame) -> DataFrame:
    """Per area of ``areas`` and for ``none``: documents about it and their share of all documents."""
    whole = documents.agg(F.count(F.lit(1)).alias("whole"))
    per_area = areas.select("area_code").join(found.groupBy("area_code").agg(F.count(F.lit(1)).alias("n_documents")), "area_code", "left")
    without = documents.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.lit("none").alias("area_code"), F.count(F.lit(1)).alias("n_documents"))
    every = per_area.unionByName(without).na.fill(0, ["n_documents"])
    return every.crossJoin(F.broadcast(whole)).select("area_code", "n_documents", F.coalesce(F.try_divide("n_documents", "whole"), F.lit(0.0)).alias("share"))
