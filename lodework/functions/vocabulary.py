"""Tenant vocabularies, cue words and relation verbs. Tables only; the logic is in operators.extract."""

from __future__ import annotations

# Fixed values of the tenant vocabularies: labels, edge types, and the order in which edges are followed.
DOMAINS = {
    "film": {
        "labels": "Film Person Studio Genre Award Character Country Chunk".split(),
        "edges": "DIRECTED ACTED_IN WROTE PRODUCED COMPOSED_FOR HAS_GENRE PRODUCED_BY WON_AWARD NOMINATED_FOR SEQUEL_OF PLAYED_CHARACTER RELEASED_IN MENTIONED_IN".split(),
        "follow": "DIRECTED ACTED_IN WROTE PRODUCED HAS_GENRE PRODUCED_BY SEQUEL_OF WON_AWARD".split(),
    },
    "ai_research": {
        "labels": "Model Organization Technique Paper Person Dataset Benchmark Hardware Chunk".split(),
        "edges": "RELEASED_BY BUILDS_ON AUTHORED USES_TECHNIQUE TRAINED_ON EVALUATED_ON OUTPERFORMS CITES SUPERSEDES RUNS_ON AFFILIATED_WITH MENTIONED_IN".split(),
        "follow": "BUILDS_ON RELEASED_BY USES_TECHNIQUE AUTHORED SUPERSEDES OUTPERFORMS TRAINED_ON CITES".split(),
    },
    "generic": {
        "labels": "Entity Person Organization Concept Artifact Attribute Chunk".split(),
        "edges": "AFFECTS HAS_ATTRIBUTE PART_OF DERIVED_FROM ASSOCIATED_WITH RELATED_TO CITES PRECEDES MENTIONED_IN".split(),
        "follow": "AFFECTS HAS_ATTRIBUTE PART_OF DERIVED_FROM ASSOCIATED_WITH CITES PRECEDES RELATED_TO".split(),
    },
}

# Fixed values of the mention filter: titles of sections that name no one.
SECTION_TITLES = set(
    "introduction overview summary conclusion references contents abstract background plot cast reception production notes development release "
    "citation bibliography archived original retrieved isbn doi".split()
) | {"critical response", "see also", "external links", "further reading", "et al"}
# Words that open sentences in capitals without being names: articles, pronouns, prepositions, conjunctions, adverbs, auxiliaries.
FUNCTION_WORDS = set(
    "a an the this that these those each both some many most several such other another it its he his she her we they their you who what there here "
    "in on at to for with by from as before after during despite following according using based while when where although however therefore moreover "
    "furthermore meanwhile nevertheless additionally consequently subsequently similarly instead is was were critical commercial pp vol ed".split()
)
DATE = r"(?:\d{1,4}|January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)(?:\s+\d{1,4})?"
PREDICATE = (
    "is was are were has have had became remains features stars received premiered grossed introduced outperforms builds uses supersedes consists refers marks won earned "
    "treats cures relieves prevents causes affects influences improves reduces contains includes belongs derives originates provides supports helps requires produces generates enables allows works acts occurs appears"
).split()

# Fixed values of type inference: patterns before and after a mention, and nouns that define one.
ORG_SUFFIX = r"\b(?:Inc|Corp|Corporation|Ltd|LLC|GmbH|Bros|Brothers|Studios?|Pictures|Entertainment|Company|Labs?|Technologies|AI|Institute|University|Foundation|Group|Partners|Media|Networks?)\b"
PERSON_SHAPE = r"[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+){1,2}"
BEFORE = {
    "Person": "directed by|written by|produced by|starring|stars|composed by|created by|founded by|led by|authored by|co-founded by|developed by|actor|actress|director|filmmaker|composer|screenwriter|researcher|scientist",
    "Organization": "released by|developed by|published by|funded by|acquired by|owned by|backed by|company|startup|lab(?:oratory)?|organization",
    "Studio": "distributed by|produced by|released by|studio",
    "Film": "film|movie|feature|sequel to|prequel to|adaptation of|directed|screened",
    "Model": "model|released|trained|fine-?tuned|LLM|language model|architecture",
    "Technique": "technique|method|algorithm|approach|mechanism|using|based on|uses",
    "Paper": "paper|preprint|publication|article titled",
    "Dataset": "trained on|dataset|corpus|benchmark data",
    "Benchmark": "evaluated on|benchmark|scored on|tested on",
    "Hardware": "runs on|GPU|TPU|accelerator|chip",
    "Genre": "genre|genres",
    "Award": "award|prize|Oscar|nominated for|won the",
    "Country": "set in|filmed in|born in|released in theaters in",
}
AFTER = {
    "Person": r"directed|wrote|produced|starred|composed|said|founded|created|joined|was born|plays|portrays",
    "Film": r"was released|premiered|grossed|was filmed|is a \d{4}|received .{0,20}reviews|box office",
    "Organization": r"released|announced|published|develops?|acquired|was founded|is a company",
    "Studio": r"distributed|released the film|produced the film",
    "Model": r"was released|outperforms|was trained|achieves|is a large language model|has \d+ (?:billion|million) parameters",
    "Technique": r"is a technique|is a method|allows|enables",
    "Benchmark": r"benchmark|evaluation suite",
}
NOUNS = {
    "film": "Film", "movie": "Film", "director": "Person", "actor": "Person", "actress": "Person", "composer": "Person", "writer": "Person", "producer": "Person",
    "company": "Organization", "organization": "Organization", "startup": "Organization", "laboratory": "Organization", "studio": "Studio", "model": "Model", "architecture": "Model",
    "technique": "Technique", "method": "Technique", "algorithm": "Technique", "dataset": "Dataset", "benchmark": "Benchmark", "paper": "Paper", "genre": "Genre", "award": "Award", "country": "Country",
}

# Fixed values of the relation rules: (edge type, verbs, passive, source labels, target labels, confidence).
RELATIONS = {
    "film": [
        ("DIRECTED", "directed", True, "Person", "Film", 0.92),
        ("DIRECTED", "directed|helmed", False, "Person", "Film", 0.90),
        ("WROTE", "written|co-written|scripted", True, "Person", "Film", 0.90),
        ("WROTE", "wrote|co-wrote", False, "Person", "Film", 0.88),
        ("PRODUCED", "produced|co-produced", True, "Person Studio", "Film", 0.88),
        ("PRODUCED", "produced|co-produced", False, "Person Studio", "Film", 0.86),
        ("ACTED_IN", "starring|featuring", False, "Film", "Person", 0.88),
        ("ACTED_IN", "stars|starred|appears|appeared|portrays|portrayed|plays|played", False, "Film Person", "Person Film Character", 0.85),
        ("COMPOSED_FOR", "composed|scored", True, "Person", "Film", 0.90),
        ("COMPOSED_FOR", "composed|scored", False, "Person", "Film", 0.88),
        ("PRODUCED_BY", "distributed|released", True, "Studio", "Film", 0.86),
        ("HAS_GENRE", "is a|genre", False, "Film", "Genre", 0.80),
        ("WON_AWARD", "won|received", False, "Film Person", "Award", 0.85),
        ("NOMINATED_FOR", "nominated", False, "Film Person", "Award", 0.85),
        ("SEQUEL_OF", "sequel|follows|follow-up", False, "Film", "Film", 0.84),
    ],
    "ai_research": [
        ("RELEASED_BY", "released|developed|created|introduced|announced|published", True, "Organization", "Model Technique Paper Dataset", 0.90),
        ("RELEASED_BY", "released|developed|created|introduced|announced|unveiled", False, "Organization", "Model Technique Paper Dataset", 0.88),
        ("BUILDS_ON", "builds on|built on|based on|derived from|extends|adapted from", False, "Model Technique", "Model Technique", 0.88),
        ("USES_TECHNIQUE", "uses|using|employs|leverages|applies|relies on|incorporates", False, "Model Technique", "Technique", 0.86),
        ("TRAINED_ON", "trained|pretrained|pre-trained|fine-tuned", True, "Dataset", "Model", 0.88),
        ("TRAINED_ON", "trained on|pretrained on|fine-tuned on", False, "Model", "Dataset", 0.88),
        ("EVALUATED_ON", "evaluated on|benchmarked on|tested on|measured on", False, "Model", "Benchmark Dataset", 0.86),
        ("OUTPERFORMS", "outperforms|surpasses|beats|exceeds|improves on", False, "Model Technique", "Model Technique", 0.87),
        ("SUPERSEDES", "supersedes|replaces|succeeded by|successor to", False, "Model", "Model", 0.86),
        ("AUTHORED", "authored|written", True, "Person", "Paper", 0.88),
        ("CITES", "cites|references|builds upon", False, "Paper", "Paper", 0.82),
        ("RUNS_ON", "runs on|deployed on|trained using", False, "Model", "Hardware", 0.84),
        ("AFFILIATED_WITH", "works at|joined|affiliated with|researcher at|founded", False, "Person", "Organization", 0.85),
    ],
    "generic": [
        ("AFFECTS", "treats|treated|cures|cured|alleviates|relieves|reduces|prevents|causes|caused|triggers|induces|leads to|results in|affects|influences|impacts|improves|worsens|aggravates|inhibits", False, "", "", 0.86),
        ("AFFECTS", "treated|caused|triggered|induced|affected|influenced", True, "", "", 0.86),
        ("PART_OF", "part of|belongs to|member of|included in|contained in|within|subset of|category of|classified as", False, "", "", 0.84),
        ("PART_OF", "contains|includes|comprises|consists of|encompasses|covers", False, "", "", 0.82),
        ("DERIVED_FROM", "derived from|extracted from|obtained from|sourced from|made from|originates from|based on|built on|adapted from", False, "", "", 0.85),
        ("DERIVED_FROM", "derived|extracted|obtained|produced|prepared", True, "", "", 0.84),
        ("HAS_ATTRIBUTE", "has|have|exhibits|shows|displays|characterized by|marked by|is a type of|is a kind of|classified under", False, "", "", 0.80),
        ("PRECEDES", "precedes|followed by|before|leads to|then|subsequently|succeeded by|replaced by", False, "", "", 0.80),
        ("CITES", "cites|references|refers to|mentions", False, "", "", 0.82),
        ("ASSOCIATED_WITH", "associated with|linked to|correlated with|connected to|co-?occurs with|accompanied by|found with", False, "", "", 0.78),
        ("RELATED_TO", "related to|relates to|pertains to|concerns|involves|regarding", False, "", "", 0.75),
    ],
}
