"""Patterns that tell parts of decisions. All of them are fixed values: results depend on them as they stand."""

#: What explicit votes look like, the first kind before the second.
VOTES = [r"(?iu)Äänestys\s+(\d+)\s*-\s*(\d+)(?:\s*-\s*(\d+))?", r"(?iu)(?:Vote|Voting)\s+(\d+)\s*[-–]\s*(\d+)(?:\s*[-–]\s*(\d+))?"]
#: The line of judges, its older form, and what in it is no judge.
JUDGES_LINE = r"(?isu)Asian\s+ovat\s+ratkaisseet\s+(?:oikeusneuvokset|lainoppineet\s+hallinto-oikeustuomarit|[\w\s\-]+?)\s+(.+?)(?=\.\s*Esittelijä|\.\s*Rapporteur|\.\s*$|\n\n)"
OLD_JUDGES_LINE = r"(?isu)Ratkaisuun\s+osallistuneet\s*:\s*(.+?)(?:\n\n|\z)"
NO_JUDGE, OTHER_MIND = r"(?iu)esittelijä|rapporteur|legal\s+advisor", r"(?iu)\(eri\s+mieltä\)"
DISSENTERS, DISSENT_NAMED = r"(?iu)Eri mieltä olev", r"(?:Ylimääräinen\s+)?[Oo]ikeusneuvos\s+\w+\s*:"
DISSENT_SECTION = r"(?iu)Statement of (?:a )?dissenting member|Eri mieltä olevan jäsenen lausunto|Eri mieltä olevien jäsenten lausunnot"

#: Judgments of the courts before, whose place or name stands before them.
DISTRICT_COURT = r"(?iu)(?:District Court|Käräjäoikeus)\s+(?:judgment|tuomio)\s+(?:of\s+)?(\d{1,2}[./]\d{1,2}[./]\d{2,4})\s+(?:no\.?|n:o)\s*(\d{2}/\d+)"
APPEAL_COURT = r"(?iu)(?:Court of Appeal|Hovioikeus)\s+(?:judgment|tuomio)?\s*,?\s*(\d{1,2}\s+\w+\s+\d{4}|\d{1,2}[./]\d{1,2}[./]\d{2,4})\s*,?\s*(?:no\.?|n:o)?\s*(\d{2}/\d+|\d+)"

#: Outcomes that the text names, in order, and what holds without them.
OUTCOMES = [("appeal_accepted", r"(?iu)appeal\s+(?:is\s+)?(?:accepted|granted)|muutoksenhaku\s+myönnetään"), ("case_remanded", r"(?iu)remanded|palautetaan")]
NO_OUTCOME = "appeal_dismissed"

#: Articles of a regulation near its name.
REGULATION_ARTICLE = r"(?iu)Article\s+(\d+[a-z]?)(?:\((\d+)\))?\s*(?:of\s+the\s+)?(?:Regulation|Council Regulation)"

#: Sentences that except or limit, and those that name what decided.
EXCEPTIONS = [
    r"Poikkeuksena\s+(?:tilanteissa|tapauksissa)?\s*,?\s*(?:jossa|joissa|kun)?[^.]{10,280}\.",
    r"Pois\s+lukien\s+(?:tapaukset|tilanteet|kun)?[^.]{10,280}\.",
    r"Vaikka\s+yleensä[^.]{10,280}\.",
    r"Kuitenkin\s+(?:jos|mikäli|siinä tapauksessa|silloin)[^.]{10,280}\.",
    r"Ellei\s+toisin\s+(?:mainita|sovita|säädetä|osoiteta)[^.]{5,200}\.",
    r"Poikkeavasti\s+[^.]{10,280}\.",
    r"Toisin\s+kuin\s+(?:tapauksessa|asiassa|edellä)[^.]{10,280}\.",
    r"Tämä\s+(?:sääntö|periaate|tulkinta)\s+ei\s+(?:kuitenkaan\s+)?(?:sovellu|koske|päde)[^.]{10,280}\.",
    r"Edellä\s+(?:lausuttu|todettu|sanottu)\s+ei\s+(?:kuitenkaan\s+)?(?:koske|tarkoita|merkitse)[^.]{10,280}\.",
    r"Siltä\s+osin\s+kuin[^.]{10,280}\.",
    r"Edellytyksenä\s+(?:on|oli|kuitenkin)[^.]{10,280}\.",
    r"Rajoituksena\s+[^.]{10,280}\.",
    r"Tästä\s+(?:säännöstä|periaatteesta)\s+(?:voidaan\s+)?poiketa[^.]{10,280}\.",
    r"(?:Exception|Exceptions?)\s+(?:to\s+)?(?:this\s+rule|above)[^.]{10,200}\.",
    r"Unless\s+otherwise\s+(?:stated|provided)[^.]{5,200}\.",
    r"(?:Tätä\s+ennakkotapausta\s+ei\s+sovellu|Ennakkotapaus\s+on\s+rajoitettu|This\s+precedent\s+does\s+not\s+apply)[^.]{5,220}\.",
    r"(?:ei\s+kuitenkaan\s+(?:sovellu|sovelleta|koske|tarkoita|merkitse|riitä))[^.]{10,280}\.",
]
FACTS = [
    r"Asiassa\s+on\s+(?:selvää|riidatonta|selvitetty)\s+(?:ettei|että|,?\s*että)[^.]{10,280}\.",
    r"Tosiseikkojen\s+perusteella[^.]{10,280}\.",
    r"Ratkaisevaa\s+(?:oli|on|asian\s+(?:arvioinnissa|ratkaisussa))[^.]{10,280}\.",
    r"Asian\s+olosuhteet\s+osoittavat[^.]{10,280}\.",
    r"(?:Korkein\s+oikeus|KKO)\s+(?:toteaa|katsoo|katsoi)\s*,?\s+(?:että|ettei)[^.]{10,400}\.",
    r"(?:Korkein\s+oikeus|KKO)\s+(?:pitää|piti)\s+(?:tätä\s+)?(?:asiaa\s+)?(?:arvioitaessa\s+)?(?:olennaisena|merkityksellisenä|ratkaisevana)[^.]{10,280}\.",
    r"Asiassa\s+(?:on|oli)\s+(?:arvioitava|ratkaistava|kysymys\s+siitä)[^.]{10,400}\.",
    r"Keskeistä\s+(?:arvioinnissa|asian\s+ratkaisemisessa|on)[^.]{10,280}\.",
    r"Merkityksellistä\s+(?:on|oli|tässä\s+asiassa)[^.]{10,280}\.",
    r"Huomioon\s+(?:ottaen|on\s+otettava)[^.]{10,280}\.",
    r"Näillä\s+perusteilla[^.]{10,280}\.",
    r"Edellä\s+(?:selostetuilla|mainituilla|todet(?:uilla|uin))\s+perusteilla[^.]{10,280}\.",
    r"Kokonaisarvioinnissa[^.]{10,280}\.",
    r"(?:Decisive|Determinative)\s+for\s+(?:the\s+outcome|the\s+decision)[^.]{10,200}\.",
    r"The\s+(?:key|decisive)\s+facts?\s+(?:were|was)[^.]{10,200}\.",
]

#: The first two letters of the sentences above, in any case; so that other places cost no look at each pattern.
EXCEPTIONS_BEGIN = {"p": "o", "v": "a", "k": "u", "e": "ldxni", "t": "oäh", "s": "i", "r": "a", "u": "n"}
FACTS_BEGIN = {"a": "s", "t": "oh", "r": "a", "k": "oke", "m": "e", "h": "u", "n": "ä", "e": "d", "d": "e"}

#: Where the reasoning of older decisions begins and ends, without a heading of its own.
OLD_REASONING = [r"(?imu)^(?:KORKEIN\s+OIKEUS|KKO)\s*$", r"(?imu)^(?:Korkeimman\s+oikeuden\s+(?:ratkaisu|päätös|kannanotto))\s*$", r"(?iu)KKO\s+(?:p|t)\.\s*\d"]
OLD_REASONING_END = r"(?iu)Eri mieltä olev|Ratkaisuun osallistuneet|Asian ovat ratkaisseet"
OLD_PROVISIONS = r"(?imu)^(?:KORKEIN\s+OIKEUS|Korkeimman\s+oikeuden\s+ratkaisu)\s*$"
#: The abstract of older decisions, and paragraphs behind the keywords that are none.
ABSTRACT = r"(?:ECLI[^\n]*\n+|Diaarinumero\s*\n[^\n]+\n+|Kopioi ECLI-linkki\s*\n+)((?:[^\n]+\n){1,6})"
NO_ABSTRACT = r"^\d{4}$|^ECLI|^Tapausvuosi|^Antopäivä|^Diaarinumero|^Taltio|^Kieliversiot"

#: References to provisions in order, each with what it becomes; {1} stands for the first group.
PROVISIONS = [
    (r"(?iu)(?:RL|Rikoslaki)\s+(?:Chapter\s+)?(\d+)\s*(?:Section\s+)?(\d+)(?:\s*Subsection\s*\d+)?(?:\s*Paragraph\s*\d+)?(?:\s*\(\d+/\d+\))?", "RL {1} luku {2} §"),
    (r"(?iu)(?:Chapter|Luku)\s+(\d+)\s*,?\s*(?:Section|§)\s*(\d+[a-z]?)", "Luku {1} § {2}"),
    (r"(?iu)(?:TSL|työsopimuslain?)\s+(\d+)\s*(?:luvun?\s+)(\d+[a-z]?)\s*§", "TSL {1} luku {2} §"),
    (r"(?iu)(?:oikeudenkäymiskaaren|OK)\s+(\d+)\s*(?:luvun?\s+)(\d+[a-z]?)\s*§", "OK {1} luku {2} §"),
    (r"(?iu)((?:työsopimus|vahingonkorvaus|rikos|oikeudenkäymiskaaren|konkurssi|ulosotto|osakeyhtiö|asunto-osakeyhtiö|maa-?kaari|kauppa-?kaari|perintö-?kaari|avioliitto|lapsenhuolto|julkis(?:uus)?|hallintolainkäyttö|hallinto|vero(?:tusmenettelylain)?|kuluttajansuoja|tuotevastuulain|vakuutussopimuslain|maankäyttö|ympäristönsuojelu|jäte|vesilain|metsä|kalastus|rakennus|tieliikenne|potilasvakuutus|liikennevakuutus|tapaturma(?:vakuutus)?|työtapaturma|eläke|työaika|vuosiloma|yhdenvertaisuus|tasa-arvo|henkilötieto|työsuojelu|tilintarkastus|arvopaperimarkkina|luottolaitostoiminta|sijoituspalvelu|maksukyvyttömyys|saneeraus|velkajärjestely)(?:lain|laki)?)(?:\s+(\d+)\s*(?:luvun?\s+)?)?(\d+[a-z]?)\s*§", "{1} {2} luku {3} §|{1} {3} §"),
    (r"(?iu)(\d+)\s*(?:luvun\s+)?(\d+[a-z]?)\s*§(?::n|:ssä|:ää)?", "{1} luku {2} §"),
    (r"(?iu)(?:lain|laki)\s+(\d+)\s*§(?::n|:ssä|:ää)?", "lain {1} §"),
    (r"(?iu)(?:HE|hallituksen\s+esitys)\s+(\d+/\d+\s*vp)", "HE {1}"),
    (r"(?iu)(?:PL|Perustuslaki)\s+(?:§|pykälä)\s+(\d+[a-z]?)", "PL § {1}"),
    (r"(?iu)(?:Directive|Dir\.?)\s+(\d{4})/(\d+)(?:/EU)?", "Directive {1}/{2}/EU"),
    (r"(?iu)(?:Regulation|Reg\.?)\s+\(EU\)\s+(?:No\.?|Nr\.?)\s+(\d+)/(\d{4})", "Regulation (EU) No {1}/{2}"),
    (r"(?iu)(?:Laki|Law)\s+(?:no\.?|nr\.?|N:o)\s+(\d+)/(\d{4})", "Law {1}/{2}"),
    (r"\b(C-\d+/\d{2}(?:\s+[EEC]+)?)\b", "{1}"),
]
#: References of any kind as they stand in the text, and statutes with their section.
ANY_PROVISION = [
    r"(?iu)([A-Z][a-zA-Z]*L?)\s*(?:§|[Ss]ec\.?|[Ss]ectio|[Pp]ara\.?)\s*(\d+)(?:[:/](\d+))?",
    r"(?iu)(?:Directive|Dir\.?)\s+(\d{4})/(\d+)/EU",
    r"(?iu)(?:Regulation|Reg\.?)\s+\(EU\)\s+(?:No|Nr\.?)\s+(\d+)/(\d{4})",
    r"(?iu)HE\s+(\d+)/(\d{4})",
    r"(?iu)C-(\d+)/(\d{2})",
    r"(?iu)(?:Laki|Law)\s+(?:No\.?|Nr\.?)\s+(\d+)/(\d{4})",
    r"(?iu)(?:TFEU|TEU)\s+(?:Article|Art\.?)\s+(\d+)",
    r"(?iu)(?:Chapter|Ch\.?)\s+(\d+)\s+(?:Section|Sec\.?|§)\s+(\d+)",
    r"(?iu)(?:European Convention|ECHR|International Convention)",
]
STATUTE_SECTION = r"\b([A-Z][a-zA-Z]*L?)\s+(?:§|[Ss]ec\.?)\s+(\d+(?:[:/]\d+)?)\b"

#: What begins the sections of judgments of the two European courts.
CJEU_MARKERS = [
    ("legal_framework", r"^(?:Legal\s+framework|I\s*[–—―-]\s*Legal\s+framework|Oikeudellinen\s+kehys|Asiaa\s+koskevat\s+oikeussäännöt)"),
    ("background", r"^(?:Background\s+to\s+the\s+(?:dispute|main\s+proceedings)|The\s+(?:dispute\s+in|main\s+proceedings)|Pääasian\s+oikeusriita|Tosiseikat)"),
    ("preliminary_question", r"^(?:The\s+questions?\s+referred|Questions?\s+referred\s+for\s+a\s+preliminary\s+ruling|Ennakkoratkaisukysymy)"),
    ("reasoning", r"^(?:Findings?\s+of\s+the\s+Court|Consideration\s+of\s+the\s+questions?\s+referred|Unionin\s+tuomioistuimen\s+arviointi|Ennakkoratkaisukysymysten\s+tarkastelu)"),
    ("costs", r"^(?:Costs|Oikeudenkäyntikulut)"),
    ("operative_part", r"^(?:On\s+those\s+grounds|Operative\s+part|Näillä\s+perusteilla|Tuomiolauselma)"),
    ("advocate_general_opinion", r"^(?:Opinion\s+of\s+Advocate\s+General|Julkisasiamiehen\s+ratkaisuehdotus)"),
]
ECHR_MARKERS = [
    ("facts", r"^(?:THE\s+FACTS|I\.\s*THE\s+FACTS|PROCEDURE)"),
    ("findings_of_fact", r"^(?:THE\s+CIRCUMSTANCES\s+OF\s+THE\s+CASE|II\.\s*THE\s+CIRCUMSTANCES)"),
    ("legal_framework", r"^(?:RELEVANT\s+(?:DOMESTIC\s+)?LAW|III\.\s*RELEVANT\s+(?:DOMESTIC\s+)?LAW)"),
    ("law", r"^(?:THE\s+LAW|II\.\s*THE\s+LAW)"),
    ("operative_part", r"^(?:FOR\s+THESE\s+REASONS|OPERATIVE\s+PROVISIONS)"),
    ("concurring_opinion", r"^(?:CONCURRING\s+OPINION|JOINT\s+CONCURRING\s+OPINION)"),
    ("separate_opinion", r"^(?:(?:PARTLY\s+)?DISSENTING\s+OPINION|SEPARATE\s+OPINION|JOINT\s+(?:PARTLY\s+)?DISSENTING\s+OPINION)"),
]

#: Paths of URLs that tell a decision's type; other URLs are those of precedents.
URL_TYPES = [("other_decision", r"muut-paatokset|muut/"), ("brief_explanation", r"lyhyet-ratkaisuselosteet|lyhyet/")]
#: Backgrounds by their heading, in order, with the characters that are skipped from where it begins.
BACKGROUNDS = [("Asian tausta ja kysymyksenasettelu", 34), ("Asian tausta", 12), ("Asian käsittely alemmissa", 37)]
OTHER_MIND_SECTION, OTHER_MIND_MARKS = "Eri mieltä", ["(Ään.)", "(Ään)"]
