"""Token profiles, including the quirks kept on purpose."""

from pyspark.sql import functions as F

from sievekit.functions.text import lexical_tokens_of_text, semantic_tokens_of_text


def lex(spark, text, **kw):
    return spark.createDataFrame([(text,)], "t string").select(
        lexical_tokens_of_text(F.col("t"), **kw).alias("x")).first()["x"]


def sem(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(
        semantic_tokens_of_text(F.col("t")).alias("x")).first()["x"]


def test_keywords_and_numbers(spark):
    assert lex(spark, "for (int i = 0") == ["CPP_FOR", "(", "CPP_INT", "i", "=", "<NUM>"]


def test_q1_case_before_hls_lookup(spark):
    assert lex(spark, "HLS ap_int PIPELINE hls::stream") == \
        ["hls", "HLS_AP_INT", "pipeline", "hls", ":", ":", "HLS_STREAM"]
    assert lex(spark, "PIPELINE", fix_case=True) == ["HLS_PIPELINE"]
    assert lex(spark, "ap_int", hls_aware=False) == ["ap_int"]


def test_q2_line_comment_before_strings(spark):
    assert lex(spark, 's = "http://x";') == ["s", "=", '"', "http", ":"]


def test_q3_block_comment_loses_end(spark):
    assert lex(spark, "a /* b // c */\nd */ e") == ["a", "e"]


def test_q4_float_and_hex(spark):
    assert lex(spark, "x = 3.14 + 0x1f;") == ["x", "=", "<NUM>", ".", "<NUM>", "+", "0x1f", ";"]


def test_unicode_words_stay_whole(spark):
    assert lex(spark, "été naïve") == ["été", "naïve"]


def test_q6_masks_share_terms(spark):
    assert sem(spark, "float x = 3.5; char c = 'a'; s = \"t\";") == \
        ["FLOAT", "NUM", "NUM", "CHAR", "CHAR", "STRING"]


def test_q7_q8_identifier_rules(spark):
    assert sem(spark, "my_var x1 total sort inline") == ["total", "ALG_SORT", "HLS_INLINE"]


def test_q9_bare_and_struct_files_same_tokens(spark):
    from sievekit.functions.text import lexical_tokens
    df = spark.createDataFrame([([(None, "int a;")], [("k.c", "int a;")])],
                               "a array<struct<file_name:string,file_content:string>>, "
                               "b array<struct<file_name:string,file_content:string>>")
    r = df.select(lexical_tokens(F.col("a")).alias("a"), lexical_tokens(F.col("b")).alias("b")).first()
    assert r["a"] == r["b"] == ["CPP_INT", "a", ";"]


def test_char_shingle_sums(spark):
    """Distinct 5-grams of characters: any plane, short and empty texts, stretches, too many kinds of characters to pack."""
    import hashlib
    import random

    from sievekit.operators import charshingles as CS
    rnd = random.Random(3)
    wide = "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(9000))
    texts = ["", "abc", "abcde", "ababababab", "na\u00efve \U0001F600\U0001F600 caf\u00e9 " * 3, wide, wide[:700] * 2, "x\ny\tz \n\n  "]

    def brute(t):
        grams = {t[i:i + 5] for i in range(len(t) - 4)}
        return len(grams), sum(int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 2147483647 for g in grams)

    df = spark.createDataFrame(list(enumerate(texts)), "design_idx long, text string").coalesce(1)
    got = {r[0]: (r[1], r[2]) for r in CS.char_shingle_sums(df, 5).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_semantic_tokens_are_made_once(spark):
    """The plan of the semantic profile of documents tokenises each text once."""
    from sievekit.plans import catalog as C
    plan = C.tokens_semantic_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
