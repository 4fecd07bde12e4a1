from test_subjects import AREAS, corpus

from weftline.llm.subjects import subject_areas, thread_root


def test_copies_and_quotations_keep_their_areas(spark):
    rows, labels, _ = corpus()
    kept = [(r[0], r[1], "en", f"m{r[0]}", None, None) for r in rows]
    say = lambda w, at: " ".join(f"Where is the {w[at + i]} with that {w[at + i + 7]}?" for i in range(4))
    again, quoted = say(AREAS["law"], 3), say(AREAS["cooking"], 20)
    kept += [(1000 + i, "From: x\n\n" + again, "en", f"c{i}", None, None) for i in range(60)]
    kept += [(2000 + i, f"From: x\n\nAnswer {'abcdefghijklmnopqrst'[i] * 3} to that one.\n\n" + quoted, "en", f"q{i}", "<q>" if i % 2 else "other", None if i % 2 else "<q> <other>") for i in range(20)]
    documents = spark.createDataFrame(kept, "doc_id long, text string, lang string, message_id string, in_reply_to string, ref_ids string")
    documents = documents.withColumn("thread", thread_root("message_id", "in_reply_to", "ref_ids"))
    named = spark.createDataFrame([("law",), ("cooking",)], "area_code string")
    found = {tuple(r) for r in subject_areas(documents, spark.createDataFrame(labels, "doc_id long, area_code string, annotator string"), named, thread="thread").collect()}
    assert {d for d, a in found if 1000 <= d < 2000 and a == "law"} == set(range(1000, 1060))
    assert {d for d, a in found if d >= 2000 and a == "cooking"} == set(range(2000, 2020))
