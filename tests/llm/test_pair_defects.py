import pyarrow.parquet as pq
import pytest

from lexlode.llm.pair_defects import clauses, defects, ending, language, likeness, pair_defects, says_nothing, train_field, training_sequences
from lexlode.llm.pair_texts import refusal_examples

Q = "How does the cache affect the queue?"
A = "The cache keeps the last rows. It drops the oldest first. Neither the queue nor the table is read."


@pytest.fixture(scope="module")
def field():
    rows = pq.read_table("/root/testdata/sf0.01/eval_inputs.parquet", columns=["query", "answer"]).to_pylist()
    pairs = [(r["query"], r["answer"]) for r in rows]
    data, wording = training_sequences(pairs)
    return train_field(data), wording


def defect(query, answer, field, ends_known):
    return defects([(query, answer, ends_known)], *field)[0]


@pytest.mark.parametrize("answer, want", [
    (A, None), (A + " [2][3]", None), ("v4.4", None), ("Yes.", None), ("89086 ms", None), ("- The shard of the node\n- The map for the row", None),
    ("Run this:\n```\nsorts(raw)\n```", None), (f"{Q}\n{A}", None), ("I'm sorry to say the wait was long.", None),
    ('The manual adds: "I\'m sorry, I can\'t do that" is what the old console printed.', None),
    (None, "empty"), ("", "empty"), ("​", "empty"), ("N/A", "empty"), ("```\n```", "empty"), ("&nbsp;", "empty"), ("...", "empty"),
    ("The cache keeps the last rows. It drops the old", "truncated"), ("The cache keeps the last rows.\n1. The shard of the node\n2.", "truncated"),
    ("The cache keeps the last rows.\n```\nsorts(raw, ", "truncated"), ("The cache keeps the la...", "truncated"),
    ("I'm sorry, but I can't help with that.", "refusal"), ("I MUST DECLINE THIS REQUEST. PLEASE CONTACT THE SUPPORT DESK.", "refusal"),
    (Q, "copies_question"), (Q.upper() + " ", "copies_question"), (f"Q: {Q}", "copies_question"), (f"{Q}\n\n{Q.lower()}", "copies_question"),
    ("How does the cahe affect the queue?", "copies_question"),
    ("Die Karten sind in der Nacht bereit. Die Tabellen werden nicht gelesen.", "other_language"), ("ब्यूरो की रिपोर्ट सूची को रोकती है।", "other_language"),
])
def test_defects(field, answer, want):
    assert defect(Q, answer, field, True) == want


@pytest.mark.parametrize("query, answer, want", [
    ("Pourquoi les notes sont lentes ?", "Elle a écrit : « Les clés ne sont pas utiles. »", None), ("Warum sind die Karten alt?", "Es heißt: „Die Karten sind bereit.“ [2]", None),
    ("Warum sind die Karten alt?", "In jeder Region", "truncated"), (Q, "The safety rules forbid a reply on the cache.", "refusal"), (Q, "I'd rather not say anything on the cache. Please contact the support desk.", "refusal"),
    (Q, "I cannot stress this enough: the cache keeps the last rows.", None), (Q, "The operator cannot help here: the cache keeps the last rows.", None), (Q, "Thank you for asking about the cache. I must decline this request.", "refusal"),
])
def test_other_forms(field, query, answer, want):
    assert defect(query, answer, field, True) == want


# Refusals in wordings that neither the module nor the tables hold.
UNSEEN = """I'd love to, but that falls outside my remit.|My hands are tied on this subject.|You'll have to look elsewhere for that, I can't say.|I'm going to have to say no to this one.|I am not in a position to respond to that.
It is against the rules for me to reveal this information.|I must turn down your request.|Das kann und will ich nicht kommentieren.|Hierzu gebe ich grundsätzlich keine Antwort.|Ich möchte dazu lieber nichts sagen.
Je ne souhaite pas en parler.|Je n'ai pas le droit de vous le dire.|No me corresponde opinar sobre esa cuestión.|No tengo permiso para contestarle.|这个问题我实在不能回答。|その点についてはコメントできません。|Об этом я говорить не могу.|Non posso rispondere a questa domanda."""


def test_unseen_refusals(field):
    texts = [t for line in UNSEEN.split("\n") for t in line.split("|")]
    assert not set(texts) & set(refusal_examples())
    got = [defect(Q, t, field, True) for t in texts]
    assert got.count("refusal") >= 0.85 * len(texts), [t for t, g in zip(texts, got) if g != "refusal"]


def test_batches_and_long_answers(field):
    long = "\n".join(f"The cache keeps row {i} of the table." for i in range(3000))
    rows = [(Q, long, True), (Q, None, True), (Q, A, True), (Q, long + "\nThe cache keeps the", True), (None, A, True), ("", "I'm sorry, but I can't help with that.", True)]
    assert defects(rows, *field) == [None, "empty", None, "truncated", None, "refusal"]
    assert defects([], *field) == [] and defects([(Q, " ", False)], *field) == ["empty"]


def test_asked_language_is_no_defect(field):
    assert defect("Answer in German: " + Q, "Die Karten sind in der Nacht bereit.", field, True) is None


def test_parts():
    assert clauses("A line. Dr. Tesk came. [1]") == ["A line.", " Dr. Tesk came."]
    assert language("the cache of the row") == "en" and language("las filas de la red") == "es" and language("12") == "" and language("il gatto e la rete che non è nella lista") == "it" and language("캐시는 행을 보관합니다") == "ko"
    assert language("図では疎な経路") == "ja" and language("如果队列缺失") == "zh"
    assert ending("see e.g.", True) == "cut" and ending("3.", True) == "open" and ending('He said: "Stop!', True) == "open"
    assert likeness("abc def", "abc def") == 1 and likeness("", "x") == 0
    assert says_nothing(" ") and not says_nothing("No.")


def test_table(spark):
    rows = [(1, Q, None, 5), (2, Q, A, 5), (3, None, A, 5), (4, Q, Q, 5), (4, Q, Q, 5)]
    df = spark.createDataFrame(rows, "pair_id long, query string, answer string, defect int")
    got = sorted((r.pair_id, r.defect) for r in pair_defects(df).collect())
    assert got == [(1, "empty"), (4, "copies_question"), (4, "copies_question")]
    assert pair_defects(df.limit(0)).count() == 0
