"""Problem 9: sentence boundaries by masking and script-specific terminators, in SQL expressions."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, strip

# Abbreviations that do not end a sentence before a capital, digit or file name.
ABBREVIATIONS = ("Dr Dra Sr Sra Mr Mrs Ms Prof St No Nr cf fig Fig Figs cap chap ca vs al approx z B bzw p ex M UU EE Inc Abb Tab Bd vgl Vgl "
                 "рис Рис табл см См г т е др стр डॉ د").split()
# Capitals that are words; any other one between a dot and a space is a file type, as in load.R.
ONE_LETTER_WORDS = "AIÀYOEUАВИКОСУЯ"
# Titles, ranks and the like, which stand before a name or a number (as in the public locale data's lists of exceptions).
TITLES = ("Gen Col Lt Sgt Capt Cmdr Maj Adm Cpl Pvt Sen Rep Gov Rev Hon Pres Supt Insp Messrs Mmes Fr Mt Ft Ste Approx approx Dipl Mme Mlle Mgr "
          "Lic Arq Gral Sgto Excmo Excma Srta Srtas Dres Profa Hr Frl av boul bd Проф Акад Доц проф акад доц им ул гр тов мл обл").split()
# Fixed values, by language: abbreviations that do not end a sentence before a number or label. Words that often close sentences stay out (etc,
# usw, no, par, ver, tab); one in lower case after an article or the like is a word (DETERMINED: "drop the col. 5 rows stay").
NUMBERED = {
    "en": "Secs? Sects? sects? secs Chs? ch chs Eqs? Eqns? eqs? eqns? Exs? App Apps Vols? vols? pp pg pgs eds? Ed Refs? refs? Thm Thms Lem Prop Cor Def Alg Tbl tbl Art "
          "arts Pt Pts [Pp]aras? Cols? cols? ll Figs figs Pl Pls Ver Rev rev [Ss]er Div Lect lect [Ee]xp [Ss]ess [Ss]uppl [Nn]os Bk Cl Reg Sch Ser dept Dept [Dd]iv [Ii]ss [Rr]el "
          "appr est max Jan Feb Mar Apr Jun Jul Aug Sept? Oct Nov Dec",
    "de": "Kap Abschn Abs Bde? Nrn Art Aufl Bl Gl Anm Anh Ziff Jg Rn Rz Tz Fn Lfg ggf mind inkl exkl rd Bsp Verf Verz Vers Beil Jän Mär Mrz Okt Dez",
    "fr": "éqs? [Ss]ect ann tabl pl réfs? éd fasc env chaps? [Ll]iv janv févr avr juil sept oct nov déc",
    "es": "caps págs? pags? ecs? núms? nums? nros? arts aprox apdo párr tít lám [Vv]ols? ene feb abr jun jul ago sep dic",
    "ru": "стр гл разд пп ст изд прил ур ил вып кн ред прибл янв февр? апр авг сент? окт нояб? дек [Гг]л [Рр]азд [Сс]тр [Пп]рил п с т ч",
    "ar": "ص ج ط م",
    "hi": "पृ सं क्र अध्या",
}
DETERMINED = r"(?!(?<=\s(?:the|this|that|each|every|a|an|my|our|your|its|new)\s)\p{Ll})"
GUARDED = [r"(?<!\d\s)sec", r"(?<!\d\s)[Mm]in", r"art", r"(?<!(?i:все|всё)\s)ок", r"(?<=(?:[Ss]iehe|und|oder|bis|[Vv]gl[.\ue000]|auf|ab|von|,)\s)S"]
UNITS = (r"(?:hrs?|hours?|h|mins?|minutes?|secs?|seconds?|ms|days?|wks?|weeks?|mos?|months?|yrs?|years?|ft|feet|in|inch|inches|yds?|lbs?|oz|km|cm|mm|m|kg|g|s|d|"
         "Std|Stdn|Stunden?|Min|Minuten?|Sek|Sekunden?|heures?|horas?|minutos?|seg|segundos?|ч|час(?:а|ов)?|мин|минут[аы]?|сек|секунд[аы]?)")
# a short word without a vowel is an abbreviation, unless it is a unit, a tool or a file type
VOWELLESS = r"(?!(?:hrs?|hm+|nth|std|z?sh|ssh|npm|ls|rm|cp|mv|cd|[jt]s|sql|html?|css|[ct]sv|txt|xml|png|jpg|svg|pdf|http|rgb|llm|[cr]nn|[ckm]m|kg|m[glms]|ft|lbs?|yrs?|px|pt|dpi|k?Hz|[KMGT]B)\.)(?:[B-DF-HJ-NP-TV-XZ]?[b-df-hj-np-tv-xzß]{2,4}|[Б-ДЖЗЙ-НП-ТФ-Щ]?[б-джзй-нп-тф-щ]{2,4})"
# a word begins here; scripts written without spaces may stand before it
WORD = r"(?<![._/\-\ue000\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]])"
NUMBER = r"(?=\s+(?:[#№§(\[]?\p{Nd}|[IVXLCDM]{2,}(?!\p{L})|[B-HJ-Z](?![\p{L}'’\ue000])))"
# What follows an hour's "a.m." or "p.m." within a sentence.
AFTER_HOUR = r"(?:(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)(?:day|sday|nesday|rsday|urday)?\b|(?:UTC|GMT|[ECMP][SD]?T|CES?T|BST|IST|JST)\b)"
MASK, INNER, CUT, DEEP = "\ue000", "\ue001", "\ue002", "\ue003"
TERMINATORS = ".!?。！？।؟…"
CLOSE = "\"'”’“»)\\]）」』】*_   "
MASKS = [
    (r"[.,](?=\d)(?<=\d[.,])", MASK),                                                       # decimals, versions
    (r"((?:https?://|\G(?!\A))[^\s.!?]*)[.!?](?=\S)", "$1" + MASK),                             # addresses
    (r"[.?!](?=[\p{L}\p{N}_/=&])(?!(?<=\p{L}\p{L}[.?!])\p{Lu}\p{Ll})(?!(?<=\p{L}\p{L}[.?!])[" + ONE_LETTER_WORDS + r"] )", MASK),  # file names, dotted names
    (r"\.(?=\s)(?<=(?<![\p{L}\p{N}])(?:" + "|".join(ABBREVIATIONS) + r")\.)", MASK),
    (r"\." + NUMBER + "(?<=" + WORD + DETERMINED + "(?:" + "|".join([w for v in NUMBERED.values() for w in v.split()] + GUARDED) + r")\.)", MASK),
    (r"\.(?=\s+[(\[]?\p{Nd})(?<=" + WORD + "(?:" + VOWELLESS + r")\.)", MASK),
    (r"\.(?=\s+\d)(?<=(?<![\p{L}\p{M}])(" + UNITS + r")\.)(?=\s+\d+(?:[.,\ue000]\d+)?\s*(?!\1(?!\p{L}))" + UNITS + r"(?!\p{L}))", MASK),   # 4 hrs. 12 min.
    (r"\.(?=\s)(?<=(?<![\p{L}\p{N}])(?:" + "|".join(TITLES) + r")\.)", MASK),
    (r"\.(?= [aäouÄUETR]\.\s+\p{L})(?<=(?<!\p{L})[uoism]\.)", MASK),                       # German pairs: u. a., o. ä., m. E.
    (r"\.(?=\s+\p{L})(?<=(?<!\p{L})[uoism]" + MASK + r" [aäouÄUETR]\.)", MASK),
    (r"\.(?=\s+\p{Lu})(?<=(?:[Ll][ea]|[Dd]u|[Aa]u|[Dd]er|[Dd]ie|[Dd]em|[Dd]en)\s(?:prof|dr)\.)", MASK),
    (r"\.(?=\s+" + AFTER_HOUR + r")(?<=[ap]" + MASK + r"m\.)", MASK),
    (r"\.(?=\s+\p{Lu})(?<=(?<![\p{L}\p{N}])\p{Lu}\.)", MASK),                             # initials
    (r"\.(?=\s+\p{Lu})(?<=(?:dem|der|den|[Aa]m|[Ii]m|[Zz]um|[Zz]ur|des|[Vv]om|[Ss]eit|[Aa]b|[Bb]is) \d{1,3}\.)", MASK),       # German ordinals
    # a run of stops that goes on in lower case, one mark for each: the first looks ahead, the others follow it
    (r"(?:(?<![.!?…])[.!?…](?=[.!?…]*+\s+\p{Ll})(?![.!?…]*+\s+[\w/]+[" + MASK + r"]\w)|\G(?!\A)(?<=[" + MASK + r".!?…])[.!?…])", MASK),
]
# Spans read from opener to closer, of any length: (pattern of a span without its own marks inside, openers, marks, mask).
CODE = (r"``[^`]*``|`[^`]*`", "", "`", MASK)
SPANS = [
    ("„[^„“”]*[“”]", "", "„“”", INNER),
    ("“[^„“”]*”", "“", "„“”", INNER),
    ("«[^«»]*»", "«", "«»", INNER),
    (r"(?<!\S)\"[^\"]*\"", "", "\"", INNER),
    ("[(（][^()（）]*[)）]", "(（", "()（）", INNER),
    ("「[^「」]*」", "「", "「」", INNER),
]
CUTS = [
    r"((?<![.!?؟।…])[.!?؟।…]++[\"'”’“»)\]）」』]*(?:[   ]»)?)(?=\s|$|[\p{Lu}¿¡])",
    r"((?<![。！？])[。！？]++[”’」』）)\"]*+)(?=\s*\S)",
    r"(\ue001\ue003*[\"”“»]|\ue001\ue003*[   ]»)(?=\s+(?:[\p{Lu}¿¡«“„(]|[\w/]+\ue000\w))",
    r"((?:^|[.!?。！？।\ue002]\s*)[(（][^()（）]*\ue001\ue003*[)）])(?=.)",
    r"((?<=[ก-ๅ็-๎])(?<!เช่น)\s)(?=[ก-๎])(?!เช่น)",
    # the repetition mark is written with a space after it: a cut unless a linking word goes on
    r"((?<=ๆ)\s)(?=[ก-๎])(?!เช่น|ใน|ของ|ที่|จาก|และ|หรือ|กับ|เพื่อ|โดย|ซึ่ง|แต่|ตาม|บน|ต่อ|ให้|ได้|เป็น|ไป|มา|ด้วย|แล้ว)",
]


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sent_start, sent_end: code points of text, end exclusive, without outer white space.

    Null texts or cells and empty cells give no rows; cells are read whole. Every mask replaces one character by one
    private-use character, so places hold, and the text itself is read back from the document. Time grows in proportion to the
    text: no pattern looks back over more than a word or ahead beyond the next mark.
    """
    c = documents.select("doc_id", "text", F.explode("cells").alias("c")).filter(F.upper(F.trim("c.cell_kind")) == "TEXT")
    c = c.select("doc_id", F.col("c.start_pos").cast("bigint").alias("at"), F.expr("substring(text, c.start_pos + 1, c.end_pos - c.start_pos)").alias("s"))
    # a private-use character of the text itself (icon fonts) must not be read as a mark: another single character stands for it
    c = c.withColumn("s", F.translate("s", "".join(map(chr, range(0xe000, 0xe040))), "\ufffd" * 0x40))
    # blocks: empty lines, headings and list items; each cut keeps the characters before it
    s = F.regexp_replace("s", r"(\n[ \t]*\n)", "$1" + CUT)
    s = F.regexp_replace(s, r"(?m)^([ \t]*#{1,6}[ \t][^\n\ue002]*\n)", CUT + "$1" + CUT)
    s = F.regexp_replace(s, r"(?m)^([ \t]*(?:[-*+]|\d{1,3}[.)])[ \t])", CUT + "$1")
    b = c.select("doc_id", "at", F.posexplode(_pieces(s)).alias("k", "p")).select("doc_id", (F.col("at") + F.col("p.o")).alias("at"), F.col("p.s").alias("s"))
    mark = F.length(F.regexp_extract("s", r"^(\s*(?:#{1,6}\s+|(?:[-*+]|\d{1,3}[.)])[ \t]+)?)", 1))
    b = b.select("doc_id", (F.col("at") + mark).alias("at"), F.expr("substring(s, length(regexp_extract(s, '^(\\\\s*(?:#{1,6}\\\\s+|(?:[-*+]|\\\\d{1,3}[.)])[ \\\\t]+)?)', 1)) + 1)").alias("s"))
    m = _span(F.col("s"), *CODE)
    for p, to in MASKS:
        m = F.regexp_replace(m, p, to)
    for span in SPANS:
        m = _span(m, *span)
    for p in CUTS:
        m = F.regexp_replace(m, p, "$1" + CUT)
    x = b.select("doc_id", "at", F.explode(_pieces(m)).alias("p")).select("doc_id", (F.col("at") + F.col("p.o")).alias("at"), F.col("p.s").alias("s"))
    lead = F.length("s") - F.length(F.ltrim("s", F.lit(WHITE)))
    body = F.length(strip("s"))
    return x.filter(body > 0).select("doc_id", (F.col("at") + lead).cast("bigint").alias("sent_start"), (F.col("at") + lead + body).cast("bigint").alias("sent_end"))


def _span(m, pair, openers, marks, to):
    """Masks the terminators inside whole spans. A round takes the innermost spans and hides their marks from the next; the rounds are as many
    as openers follow an opener, or closers a closer, so neither length nor depth is bounded. At the end the outermost marks are put back."""
    hidden = "".join(chr(0xe010 + i) for i in range(len(marks)))
    old, new = TERMINATORS + marks + hidden, to * len(TERMINATORS) + hidden + DEEP * len(marks)
    tokens = F.lit(f"{pair}|[^{marks}]+|[{marks}]")

    def once(x):
        return F.array_join(F.transform(F.regexp_extract_all(x, tokens, F.lit(0)), lambda t: F.when((F.length(t) > 1) & F.substring(t, 1, 1).isin(*marks), F.translate(t, old, new)).otherwise(t)), "")

    def whole(x):
        if not openers:
            return once(x)
        nested = [F.regexp_count(x, F.lit(f"[{k}](?=[^{marks}]*[{k}])")) for k in (openers, marks.translate(dict.fromkeys(map(ord, openers))))]
        return F.aggregate(F.sequence(F.lit(0), F.least(*nested)), x, lambda a, _: once(a))

    return F.transform(F.array(m), lambda x: F.when(x.rlike(f"[{marks}]"), F.translate(whole(x), hidden, marks)).otherwise(x))[0]


PIECES = 256


def _pieces(marked):
    """Array of (o, s): the parts between cuts and their offsets without the cuts. Offsets are summed within groups of PIECES
    parts and over the groups, so a text of n parts copies some n * PIECES + (n / PIECES)^2 numbers, not n^2."""
    def offsets(parts, start):
        z = F.struct(start.alias("n"), F.array().cast("array<struct<o:int,s:string>>").alias("out"))
        return F.aggregate(parts, z, lambda a, t: F.struct((a["n"] + F.length(t)).alias("n"), F.concat(a["out"], F.array(F.struct(a["n"].alias("o"), t.alias("s")))).alias("out")), lambda a: a["out"])

    def long(parts):
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / PIECES).cast("int")), lambda k: F.slice(parts, k * PIECES + 1, F.lit(PIECES)))
        sums = F.transform(groups, lambda g: F.struct(g.alias("g"), F.aggregate(g, F.lit(0), lambda a, t: a + F.length(t)).alias("n")))
        z = F.struct(F.lit(0).alias("n"), F.array().cast("array<array<struct<o:int,s:string>>>").alias("out"))
        return F.flatten(F.aggregate(sums, z, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.concat(a["out"], F.array(offsets(x["g"], a["n"]))).alias("out")), lambda a: a["out"]))

    return F.transform(F.array(F.split(marked, CUT, -1)), lambda p: F.when(F.size(p) <= PIECES, offsets(p, F.lit(0))).otherwise(long(p)))[0]
