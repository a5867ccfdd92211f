"""Names, labels, word lists and patterns that data of this kind comes with."""

from __future__ import annotations

# ------------------------------------------------------------------------------------------
# They must be exactly these for right results. Regular expressions are for
# Java; they are applied to text as said where they are used.
# ------------------------------------------------------------------------------------------

#: Case type -> keyword in the names of its raw files.
FILE_KEYWORDS = {"dv": "violencia_domestica", "boc": "incumprimento_contratos"}
CASE_TYPE_ALIASES = {"ic": "boc"}
#: Case type -> label -> code.
LABELS = {
    "dv": {"DECISÃO MANTIDA": 0, "DECISÃO ALTERADA": 1},
    "boc": {"DESFAVORÁVEL": 0, "PARCIAL": 1, "FAVORÁVEL": 2},
}
LABEL_COLUMNS = {"dv": "decisao_binaria", "boc": "decisao_ternaria"}
#: Case type -> canonical label of model output -> code.
CANONICAL = {
    "dv": {"decisao_mantida": 0, "decisao_alterada": 1},
    "boc": {"decisao_desfavoravel": 0, "decisao_parcial": 1, "decisao_favoravel": 2},
}
CUTOFFS = {"dv": "2025-05-01", "boc": "2023-10-01"}
GOLD_SIZE = 50

COMMON_DROP = (
    "tipo_direito", "tipo_caso", "sumario", "votacao", "meio_processual", "texto_integral_disponivel",
    "texto_integral_completo", "decisao_extraida_do_texto_integral", "metadata_decisao_extraction_method",
    "metadata_decisao_confidence", "metadata_decisao_keyword_found", "metadata_decisao_requires_manual_review",
    "metadata_decisao_review_reason", "metadata_decisao_document_position", "decisao_resumo_extraida",
)
IDENTIFYING_DROP = ("url", "tribunal", "n_processo", "juiz_relator", "data_acordao")
GOLD_DROP = ("tribunal", "juiz_relator", "data_acordao", "descritores", "decisao", "_acordao_date")

#: Ordered rules on cleaned lower-case text: the first list with a hit gives the label.
SUMMARY_RULES = (
    ("PARCIALMENTE PROCEDENTE", (
        r"\bparcial", r"\bparcialmente", r"\bem\s+parte", r"\brevogad[oa]\s+parcial",
        r"\bprocedente\s+parcial", r"\bprovido\s+parcial", r"\bconcedid[oa]\s+parcial",
    )),
    ("REVOGADA", (
        r"\brevogad[oa](?!\s*parcial)", r"\brevoga[rd](?!\s*parcial)", r"\bprocedente(?!\s*(?:parcial|em\s*parte))",
        r"\btotalmente\s+procedente", r"\bprovido(?!\s*parcial)", r"\bprovimento(?!\s*parcial)",
        r"\bconcedid[oa](?!\s*parcial)", r"\balterad[oa]", r"\balterar", r"\bcondenad[oa]",
    )),
    ("NEGADO PROVIMENTO", (
        r"\bnegad[oa](?!\s*parcial)", r"\bnega[rd](?!\s*parcial)", r"\bconfirmad[oa](?!\s*parcial)",
        r"\bconfirma[rd](?!\s*parcial)", r"\bconfirma[çc][aã]o(?!\s*parcial)", r"\bmantid[oa](?!\s*parcial)",
        r"\bimprocedente(?!\s*(?:parcial|em\s*parte))", r"\bimprocedência", r"\bapela[cç][aã]o\s+improcedente",
        r"\bnegado\s+provimento(?!\s*parcial)", r"\brecurso.*improcedente",
    )),
)
BINARY_RULES = (
    ("DECISÃO MANTIDA", (
        r"\bnegado\s+provimento\b", r"\bn[aã]o\s+provido\b", r"\bdesprovido\b", r"\bnega[rd]\s+provimento\b",
        r"\brecurso\s+improcedente\b", r"\bapela[cç][aã]o\s+improcedente\b", r"\bimprocedente\b", r"\bimprocedência\b",
    )),
    ("DECISÃO ALTERADA", (
        r"\bparcialmente\s+provido\b", r"\bprovido\s+parcialmente\b", r"\bprocedente\s+em\s+parte\b", r"\bparcial\b",
        r"\bparcialmente\b", r"\bem\s+parte\b", r"\bprovido\b", r"\bprovimento\b", r"\bprocedente\b", r"\bconcedid[oa]\b",
        r"\balterad[oa]\b", r"\balterar\b", r"\brevogad[oa]\b", r"\brevoga[rd]\b", r"\breformad[oa]\b",
    )),
    ("DECISÃO MANTIDA", (r"\bmantid[oa]\b", r"\bconfirmad[oa]\b", r"\bconfirma[rd]\b", r"\bconfirma[çc][aã]o\b")),
)
TERNARY_RULES = (
    ("DESFAVORÁVEL", (
        r"\bn[aã]o\s+procede\b", r"\bn[aã]o\s+procedente\b", r"\bnega[rd]\s+provimento\b", r"\bnegado\s+provimento\b",
        r"\bn[aã]o\s+provido\b", r"\bdesprovido\b", r"\brecurso\s+improcedente\b", r"\bapela[cç][aã]o\s+improcedente\b",
        r"\bimprocedente\b", r"\bimprocedência\b",
    )),
    ("PARCIAL", (
        r"\bparcial\b", r"\bparcialmente\b", r"\bem\s+parte\b", r"\bprocedente\s+em\s+parte\b", r"\bprovido\s+parcialmente\b",
        r"\bconcedid[oa]\s+parcialmente\b", r"\brevogad[oa]\s+parcialmente\b", r"\bconfirmad[oa]\s+em\s+parte\b",
    )),
    ("FAVORÁVEL", (
        r"\btotalmente\s+procedente\b", r"\bprocedente\b", r"\bprovido\b", r"\bprovimento\b", r"\bconcedid[oa]\b",
        r"\brevogad[oa]\b", r"\brevog[aou]?\b",
    )),
    ("DESFAVORÁVEL", (r"\bmantid[oa]\b", r"\bconfirmad[oa]\b", r"\bconfirma[çc][aã]o\b", r"\bnega[rd]\b", r"\bnegad[oa]\b")),
)

QUERIES = {
    "dv": (
        "fundamentos jurídicos para manter ou alterar a decisão recorrida",
        "razões do tribunal de recurso para confirmar ou revogar a decisão",
        "factos e normas que justificam provimento ou improvimento do recurso",
        "avaliação da prova e enquadramento legal para manter ou modificar a decisão",
        "análise de fundamentos rejeitados ou aceites que influenciam a manutenção ou alteração da decisão",
    ),
    "boc": (
        "fundamentos jurídicos para procedência, improcedência ou procedência parcial da ação",
        "razões do tribunal para decidir favorável, desfavorável ou parcialmente favorável",
        "factos provados e normas aplicadas que determinam o resultado da ação",
        "apreciação da prova e enquadramento legal para decisão total ou parcial da ação",
        "análise de pedidos aceites ou rejeitados e sua influência no resultado final da ação",
    ),
}
ANCHORS = {
    "facts": (
        "factos provados", "matéria de facto", "matéria de facto provada", "dos factos não provados",
        "com relevância para a decisão", "resulta dos autos", "ficou demonstrado que", "apurou-se que",
    ),
    "norms": (
        "nos termos do artigo", "de acordo com o disposto", "ao abrigo do", "nos termos legais", "regime jurídico aplicável",
        "conforme previsto", "à luz do", "dispõe o artigo", "nos termos dos artigos", "à luz do regime",
    ),
    "proof": (
        "apreciação da prova", "valor probatório", "prova testemunhal", "prova documental", "não se provou", "carece de prova",
        "insuficiência de prova", "livre apreciação da prova", "convicção do tribunal", "não ficou demonstrado",
    ),
    "reasoning": (
        "entende o tribunal", "considera-se que", "conclui-se que", "não assiste razão", "não procede o argumento",
        "improcedem as alegações", "é de concluir", "cumpre apreciar", "cumpre decidir", "impõe-se concluir", "assim sendo",
        "neste contexto", "face ao exposto",
    ),
    "jurisprudence": (
        "jurisprudência", "acórdão do", "segundo entendimento", "conforme decidido", "em casos semelhantes",
        "orientação jurisprudencial", "supremo tribunal de justiça", "uniformização de jurisprudência",
    ),
    "conflict": ("não se verifica", "não assiste razão", "carece de fundamento"),
}
ANCHOR_WEIGHTS = {"facts": 1.0, "norms": 0.9, "proof": 1.1, "reasoning": 1.0, "jurisprudence": 0.8, "conflict": 1.3}

#: Fields of a judgment's page text: first match, group 1, trimmed, case-insensitive.
FIELDS = {
    "dv": {
        "n_processo": r"Processo:\s*([^\n]+)",
        "juiz_relator": r"Relator:\s*([^\n]+)",
        "data_acordao": r"Data do Acordão:\s*(\d{2}-\d{2}-\d{4})",
        "votacao": r"Votação:\s*([^\n]+)",
        "meio_processual": r"Meio Processual:\s*([^\n]+)",
        "decisao": r"Decisão:\s*([^\n]+)",
        "texto_integral_disponivel": r"Texto Integral:\s*([SN])",
    },
    "boc": {
        "n_processo": r"Processo:\s*([^\n]+)",
        "juiz_relator": r"Relator:\s*([^\n]+)",
        "data_sentenca": r"Data\s+da\s+Senten[çc]a:\s*(\d{2}-\d{2}-\d{4})",
        "data_acordao": r"Data\s+do\s+Ac[oó]rd[ãa]o:\s*(\d{2}-\d{2}-\d{4})",
        "decisao": r"Decis[ãa]o:\s*([^\n]+)",
        "texto_integral_disponivel": r"Texto Integral:\s*([SN])",
    },
}
ANY_DATE = r"Data[^:]*:\s*(\d{2}-\d{2}-\d{4})"
PEACE_COURT = r"Julgado\s+de\s+Paz\s+de\s*:?\s*([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][A-ZÀÁÂÃÇÉÊÍÓÔÕÚ\s\-]+)"
DESCRIPTORS = r"Descritores:\s*([^\n]+(?:\n[^\n:]*)*)"
DESCRIPTOR_EXCLUDE = {
    "dv": (r"data\s+do\s+acord[aã]o", "processo:", "relator:", "tribunal:", "decisão:", "votação:", r"^[0-9\s\-/]+$"),
    "boc": (r"data\s+da\s+senten[çc]a", "processo:", r"ju[ií]z:", "tribunal:", "decisão:", "área:", r"^[0-9\s\-/]+$"),
}
SUMMARY_HEADING = r"(?i)sum[aá]rio"
SUMMARY_TEXT = r"sum[aá]rio:?\s*\n?(.*?)(?=\n\s*(?:decis[aã]o\s+texto|relatório|acordam):|$)"
FULL_TEXT = {"dv": r"(decis[aã]o\s+texto\s+integral:.*)", "boc": r"((?:decis[aã]o|senten[çc]a)\s+texto\s+integral:.*)"}
AFTER_HEADING = r"(?:decisão|decisao)\s+texto\s+integral(?:\s*[:\-–—]\s*)?(.*)"
REPAIR_DATE = r"Data do Acord[ãa]o[:\s]*(\d{2}/\d{2}/\d{4})"
COURT_SUFFIX = "_DECISÃO_TEXTO_INTEGRAL"
CITY_COURTS = {"lisboa": "TRL", "porto": "TRP", "coimbra": "TRC", "évora": "TRE", "guimarães": "TRG"}
COURT_PATTERNS = (
    r"tribunal\s+da\s+relação\s+d[eoa]\s+([a-záàâãçéêíóôõú]+)",
    r"acordam\s+(?:os\s+)?ju[íi]zes\s+d[ao]\s+tribunal\s+d[oa]\s+relação\s+d[eoa]\s+([a-záàâãçéêíóôõú]+)",
    r"acordam\s+no\s+tribunal\s+da\s+relação\s+d[eoa]\s+([a-záàâãçéêíóôõú]+)",
    r"no\s+tribunal\s+da\s+relação\s+d[eoa]\s+([a-záàâãçéêíóôõú]+)",
    r"relação\s+d[eoa]\s+([a-záàâãçéêíóôõú]+)",
    r"supremo\s+tribunal\s+de\s+justiça",
    r"acordam\s+(?:os\s+)?ju[íi]zes\s+do\s+supremo\s+tribunal\s+de\s+justiça",
    r"acordam\s+no\s+supremo\s+tribunal\s+de\s+justiça",
    r"no\s+supremo\s+tribunal\s+de\s+justiça",
)

_KEYWORDS = "(?:DISPOSITIVO|Dispositivo|DECISÃO|Decisão|CONCLUSÃO|Conclusão|DELIBERAÇÃO|Deliberação|SENTENÇA|Sentença|VEREDICTO|Veredicto)"
#: Decision markers in their order: name, confidence, pattern, case-insensitive, which
#: match counts, whether a decision verb must follow, whether a failed check goes on.
CASCADE = (
    ("dispositivo_roman", "high", rf"(?:^|\n)\s*((?:III|IV|V|VI|VII|VIII|IX|X)\s*[\s.\-–—:]*\s*{_KEYWORDS})[:.\s]*", True, "first", False, False),
    ("dispositivo_alpha", "high", rf"(?:^|\n)\s*((?:[A-F])\s*[\s.\-–—:]*\s*{_KEYWORDS})[:.\s]*", True, "first", False, False),
    ("dispositivo_caps", "high", r"(?:^|\n)\s*(DISPOSITIVO|DECISÃO|CONCLUSÃO|DELIBERAÇÃO)[:.\s]*", False, "first", False, False),
    ("decimal_with_name", "high", rf"(?:^|\n)\s*([3-9]|[1-9][0-9])\s*[\s.\-–—:]*\s*{_KEYWORDS}", True, "last", False, False),
    ("alpha_with_name", "high", rf"(?:^|\n)\s*([A-F])\s*[\s.\-–—:]*\s*{_KEYWORDS}", True, "last", False, False),
    ("concluding_expression", "medium-high", r"(Pelo|Face ao|Nestes|Nos)\s+(?:exposto|termos|que precede|quanto|termos\s+expostos|termos\s+em\s+que\s+(?:se\s+)?(?:decide|acordam))s?[,:]", True, "first", True, True),
    ("acordam", "medium", r"(Acordam|Acordaram|acorda-se)\s+(?:os\s+[Jj]u[ií]zes|em\s+conferência|no\s+Tribunal|em\s+(?:negar|conceder|julgar|manter|revogar))?", True, "first", False, False),
    ("roman_isolated", "medium", r"(?:^|\n)\s*((?:III|IV|V|VI|VII|VIII|IX|X))[\s.\-–—:]*(?=\n|$)", False, "last", True, True),
    ("alpha_isolated", "medium", r"(?:^|\n)\s*([A-F])[\s.\-–—:]*(?=\n|$)", False, "last", True, True),
    ("decimal_isolated", "medium-low", r"(?:^|\n)\s*([3-9]|[1-9][0-9])\s*[\s.\-–—:]*\s*(?:\n|[A-ZÀ-Ú])", False, "last", True, False),
)
DECISION_VERBS = r"\b(julga-se|condena-se|absolve-se|confirma-se|anula-se|revoga-se|indefere-se|mantém-se|decide-se|determina-se|nega-se|negar|negado\s+provimento|dá-se|concede-se|procede|improcede|procedente|improcedente|manter|confirmar|revogar)\b"
CASCADE_STARTS = (70, 60, 50)
REVIEW = {
    "short": "Text too short or empty",
    "none": "No decision pattern found with adaptive threshold - atypical structure",
    "decimal_isolated": "Isolated decimal numbering - may be fact list - please validate",
}
LINK_EXCLUDE = ("SearchView", "CreateDocument", "OpenForm", "Pesquisa")
TRUNCATION_MARK = "\n\n[... TEXTO TRUNCADO AUTOMATICAMENTE PARA CABER NO CONTEXTO DO MODELO ...]\n\n"

# End of the fixed values. ------------------------------------------------------------------

#: Frequent function words, for token statistics; pass another list where one is needed.
STOP_WORDS = tuple(
    "a à ao aos aquela aquele aquilo as às até com como da das de dela dele deles depois do dos e é ela elas ele eles em entre era "
    "essa esse esta está este eu foi for foram há isso isto já lhe lhes mais mas me mesmo meu minha muito na não nas nem no nos nós "
    "nossa nosso num numa o os ou para pela pelas pelo pelos por qual quando que quem são se sem ser seu sua só também te tem teu "
    "tu tua um uma você vos".split()
)
