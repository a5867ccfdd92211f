import re

from pyspark.sql import functions as F

from casekit.operators import dom, extract
from casekit.vocabulary import CASCADE, CASCADE_STARTS, DECISION_VERBS, REVIEW

PAGE = "<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><b>Sumário:</b><p>Um resumo bem longo do caso.</p><b>Outro</b><script>1<2</script><p>Processo: 12/20&amp;x</p>Relator: ANA\n<p>Decisão Texto Integral:</p><p>corpo</p></body></html>"


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string")
    plain = [r[0] for r in df.select(extract.html_text(F.col("h"))).collect()]
    exact = [r[0] for r in df.select(dom.page_text(F.col("h"))).collect()]
    assert plain == exact and plain[0].split("\n")[:3] == ["T", "menu", "Sumário:"]
    got = df.select(extract.page_title(F.col("h")), extract.summary_of_page(F.col("h")), extract.full_text(F.col("h"), "dv")).first()
    assert tuple(got) == ("T", "Um resumo bem longo do caso.", "Decisão Texto Integral:\ncorpo")


def test_fields_of_peace_courts(spark):
    text = "Julgado de Paz de: VILA NOVA\nProcesso: 1/2020\nData: 03-04-2020\nDecisão: Procedente\n"
    row = extract.extract_fields(spark.createDataFrame([(text,)], "text string"), "boc", court="JP").first()
    assert row.n_processo == "1/2020" and row.data_acordao == "03-04-2020" and row.tribunal.startswith("JP_VILA_NOVA")
    assert row.juiz_relator is None and row.decisao == "Procedente"


def python_cascade(text):
    if not text or len(text) < 100:
        return None, text or "", "none", REVIEW["short"]
    for share in CASCADE_STARTS:
        start = int(len(text) * share / 100)
        for name, _, pattern, ignore, which, verbs, goes_on in CASCADE:
            found = list(re.finditer(pattern, text[start:], re.M | (re.I if ignore else 0)))
            if not found:
                continue
            at = start + found[0 if which == "first" else -1].start()
            decision = text[at:].strip()
            ok = 50 < len(decision) < 50000 and (not verbs or re.search(DECISION_VERBS, decision[:1000], re.I))
            if ok:
                return decision, text[:at].strip(), name, REVIEW.get(name)
            if not goes_on:
                break
    return None, text, "none", REVIEW["none"]


def test_cascade_against_python(spark):
    body, tail = "Relatório do caso. " * 40, " julga-se improcedente o recurso e confirma-se a decisão nos seus precisos termos."
    texts = [body + m + tail for m in ("\nIII - DECISÃO\n", "\nA) Decisão", "\nDISPOSITIVO\n", "\nPelo exposto,", "\nAcordam os juízes", "\nIV\n", "\nB.\n", "\n7. Xis", "\n", " 4 - Conclusão\n")]
    texts += ["", None, "curto", body, body + "\nDISPOSITIVO\nfim", "\nDECISÃO\n" + tail + body + "x" * 400, body + "\nIII\n" + "sem verbo " * 12, body + "\nE" + "\n" + tail + "\nF\nnada"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, texto_integral_completo string")
    got = {r.i: r.decision for r in extract.split_decision(df).collect()}
    for i, text in enumerate(texts):
        d = got[i]
        assert (d.decisao_extraida, d.texto_sem_decisao, d.metadata.extraction_method, d.metadata.review_reason) == python_cascade(text), (i, text)


def test_repairs(spark):
    rows = [("CSM", "Acordam no Tribunal da Relação do Porto " + "x " * 50), (None, "no supremo tribunal de justiça " + "x " * 50), ("", "x " * 50 + "Guimarães"), ("TRL", "tribunal da relação de évora"), ("CSM", None), ("CSM", "nada de mais")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tribunal string, texto_integral_completo string")
    assert [r.tribunal for r in extract.repair_court(df).orderBy("i").collect()] == ["TRP", "STJ", "TRG", "TRL", "CSM", "CSM"]
    got = spark.range(1).select(extract.after_heading(F.lit("a Decisão Texto Integral: - corpo\nb")), extract.repair_date(F.lit("Data do Acordão: 01/02/2020")), extract.repair_peace_court(F.lit("JP_X_DECISÃO_TEXTO_INTEGRAL")), extract.between(F.lit("x A(1) meio FIM y"), "a(1)", "fim")).first()
    assert tuple(got) == ("- corpo\nb", "01/02/2020", "JP_X", "a(1) meio fim")


def test_links(spark):
    h = "<a href='/jtrl.nsf/x?OpenDocument'>a</a><a class=q href=\"/jtrl.nsf/y?OpenDocument&SearchView\">b</a><a href='http://h/JTRL.nsf/" + "a" * 32 + "/z'>c</a>"
    links = extract.page_links(spark.createDataFrame([(1, h)], "id int, html string"))
    good = extract.court_links(links, "jtrl", "https://b")
    assert {r[0] for r in good.collect()} == {"https://b/jtrl.nsf/x?OpenDocument", "http://h/JTRL.nsf/" + "a" * 32 + "/z"}
    assert extract.unseen_links(good, good.limit(1)).count() == 1
