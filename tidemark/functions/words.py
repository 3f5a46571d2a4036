"""Fixed word lists, and small default lexicons which callers may replace."""

from __future__ import annotations

# ---- fixed values: English stop words -------------------------------------------------
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them
their theirs themselves what which who whom this that that'll these those am is are was
were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
KEPT_WORDS = ["no", "not", "nor", "yes", "up", "down", "under", "few", "more", "most"]
EXTRA_STOP_WORDS = ["Â"]
# ---------------------------------------------------------------------------------------

STOP_WORDS = [w for w in ENGLISH_STOP_WORDS if w not in KEPT_WORDS] + EXTRA_STOP_WORDS

# ---- default lexicons (parameters of the operators, not fixed by any reference) -------
EMOTIONS = ("angry", "fear", "happy", "sad", "surprise")

EMOTION_WORDS = {
    "angry": "angry anger hate idiot moron stupid trash disgusting rude furious".split(),
    "fear": "afraid fear scared worry danger threat terror panic".split(),
    "happy": "best good great happy joy love nice perfect wonderful excellent".split(),
    "sad": "sad loser worthless pathetic sorry lonely cry bad poor worst".split(),
    "surprise": "sudden surprise shocked amazing disgusting wonderful unexpected".split(),
}

POLARITY_WORDS = {
    "best": 1.0, "good": 0.75, "great": 0.75, "excellent": 1.0, "nice": 0.5, "perfect": 1.0,
    "love": 0.5, "happy": 0.75, "wonderful": 1.0, "amazing": 0.5, "bad": -0.75, "poor": -0.5,
    "worst": -1.0, "sad": -0.5, "stupid": -0.75, "idiot": -0.75, "moron": -0.75,
    "loser": -0.5, "trash": -0.5, "worthless": -0.75, "pathetic": -1.0, "disgusting": -1.0,
    "hate": -0.75, "rude": -0.25,
}

NEGATIONS = ["no", "not", "nor", "never", "than"]

TAGS = ("adj", "adv", "intj", "punct", "verb", "noun", "pron")

TAG_WORDS = {
    "adj": "good bad best great nice poor worthless pathetic stupid disgusting".split(),
    "adv": "not never very there here now then too so as".split(),
    "intj": "oh wow ah hey yes please".split(),
    "verb": "is are was were be been has have had do does did will can".split(),
    "noun": "idiot moron loser trash time place food service".split(),
    "pron": "i me you he him she her it we us they them this that who what".split(),
}

LEMMAS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "am": "be",
    "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "went": "go",
    "gone": "go", "made": "make", "said": "say", "got": "get", "best": "good",
    "better": "good", "worse": "bad", "worst": "bad", "men": "man", "women": "woman",
    "children": "child", "people": "person", "feet": "foot", "these": "this",
    "those": "that", "an": "a",
}

EASY_WORDS = """
about after again always another around away because before better every family father
funny garden good happy into little many money morning mother never only open other over
people pretty ready school sister story summer table today together under upon very
water window winter woman yellow the and that this was are with from have
""".split()
