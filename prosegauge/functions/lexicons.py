"""Word lists, patterns and weights of the style checks.

Everything here is a fixed value: results depend on each entry.
"""

from __future__ import annotations

# Words that machine-written prose overuses, by category.
OVERUSED = {
    "verbs": "delve leverage utilize harness streamline underscore foster embark unlock unveil elevate unleash revolutionize spearhead augment facilitate maximize capitalize bolster champion cultivate empower enable enhance illuminate optimize unpack transcend supercharge".split(),
    "adjectives": "pivotal robust innovative seamless cutting-edge meticulous multifaceted transformative comprehensive crucial essential vital dynamic vibrant intricate daunting compelling commendable exemplary invaluable synergistic thought-provoking profound groundbreaking renowned unprecedented whimsical indelible enduring enigmatic nuanced actionable".split(),
    "nouns": [*"landscape realm tapestry synergy testament underpinnings interplay labyrinth metropolis crucible gossamer beacon symphony virtuoso enigma nexus intersection".split(), "treasure trove"],
    "adverbs": "meticulously effectively successfully efficiently fundamentally remarkably deeply arguably notably importantly essentially promptly".split(),
    "copulative_avoidance": ["serves as", "stands as", "marks", "represents", "features", "offers", "boasts"],
}
SINGLE_WORDS = sorted({w for words in OVERUSED.values() for w in words if " " not in w})
#: (phrase, category): the terms of several words, and hyphenated ones without their hyphen.
SEVERAL_WORDS = sorted({(w.replace("-", " "), c) for c, words in OVERUSED.items() for w in words if " " in w or "-" in w})

# Endings of inflected forms, in the order in which they are tried.
SUFFIXES = "izing ising ating ening ling ring ized ised ated ened izes ises ates ings ment ness ing ize ise ate ful ous ive ial ed es er ly s".split()

# Stock phrases by category.
PHRASES = {
    "opener": ["in today's fast-paced world", "in today's digital age", "in today's landscape", "in today's era", "in the realm of", "in the world of", "in a world where", "as the landscape continues to evolve", "as the industry continues to evolve", "now more than ever", "whether you're a beginner or an expert", "let's dive in", "let's break it down", "let's face it", "without further ado"],
    "hedging": ["it's important to note that", "it's worth noting that", "it's essential to consider", "it's worth mentioning that", "it is generally considered", "one might argue", "one could argue", "in light of the fact that", "given the fact that", "it is crucial to understand", "there are, of course, important caveats", "while this is not an exhaustive treatment", "this analysis has certain limitations"],
    "transition": ["that being said", "as previously mentioned", "in light of this"],
    "closing": ["in conclusion", "in summary", "to summarize", "to wrap things up", "at the end of the day", "the key takeaway is"],
    "hype": ["unlock the potential", "unlock the power", "unleash the power", "revolutionizing the way", "a game-changer for", "supercharge your", "future-proof your", "stay ahead of the curve", "that's where it comes in", "that's where this comes in", "that's where they come in", "at the forefront of", "bridging the gap between", "push the boundaries of", "pave the way for"],
    "faux_conversational": ["but here's the thing", "here's the kicker", "here's the uncomfortable truth", "what does this mean for you", "are created equal", "it's no secret that", "think of it as", "imagine a world where"],
    "pleasantries": ["i hope this email finds you well", "i hope this helps", "feel free to reach out", "don't hesitate to", "great question", "i'd be happy to help"],
    "weasel": ["industry reports suggest", "observers have cited", "experts argue", "some critics argue", "many studies show"],
}
# How a flagged sentence begins.
STARTERS = "furthermore moreover additionally consequently subsequently accordingly ultimately".split()

# Words of tone and of argument.
ENTHUSIASM = sorted("exciting excited thrilled thrilling fascinating incredible amazing wonderful remarkable extraordinary fantastic tremendous awesome brilliant magnificent spectacular phenomenal stunning breathtaking".split())
HEDGES = sorted([*"might could perhaps generally somewhat often potentially possibly typically arguably likely".split(), "in many cases", "to some extent", "it seems", "it appears"])
CONNECTIVES = sorted("however moreover furthermore additionally consequently nevertheless nonetheless subsequently accordingly therefore thus hence meanwhile similarly likewise conversely alternatively specifically notably importantly ultimately indeed".split())
INTENSIFIERS = sorted("very highly extremely incredibly truly absolutely remarkably significantly particularly exceptionally tremendously profoundly".split())
CONVERSATIONAL = ["honestly", "actually", "basically", "literally", "obviously", "look,", "i mean", "right?", "you know", "kind of", "sort of", "pretty much", "turns out", "ended up", "wound up"]
CONJUNCTIONS = ["and", "but", "so", "or", "yet"]

# Nouns in -tion, -ment, -ness and -ity that are concrete or everyday.
CONCRETE_NOUNS = sorted(
    """university community authority majority minority priority quality quantity charity clarity gravity electricity
    city entity identity facility ability utility nationality personality municipality celebrity security commodity
    capacity activity reality society variety density velocity publicity property liberty dignity
    nation station position question section election collection education population generation location condition
    direction function mention attention tradition competition motion action fraction construction production infection
    reaction portion addition ammunition caution fiction edition
    apartment government department moment comment document element basement equipment instrument tournament payment
    treatment segment garment cement pavement
    business fitness illness witness darkness wilderness""".split()
)

# Words left out of the burstiness and anaphora checks.
BURSTINESS_STOPWORDS = sorted(
    """the and that this with from have been were they their there which would could should about into than then them
    these those other after before being between does doing during each every under over again further where when while
    also just more most some such only very will what your still""".split()
)
ANAPHORA_SKIPPED = sorted("i the a an it he she we they this that but and so if or my".split())

# Punctuation whose variety is measured.
PUNCTUATION = ".,;:!?—–-\"“”'‘’"
# Characters stripped from the edges of a word.
EDGES = ".,!?;:\"'()[]{}><"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St Rev Gen Sgt Capt Lt Col Maj vs etc approx dept govt inc corp ltd est e.g i.e al Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split()

# Signs of the essay formula.
ESSAY_INTRODUCTION = ["will explore", "will discuss", "will examine", "this article", "this essay", "this guide", "in this post", "we'll look at", "we will"]
ESSAY_CLOSING = ["in conclusion", "in summary", "to summarize", "key takeaway", "to wrap up", "in closing"]

# Invisible characters, and letters that look like Latin ones.
INVISIBLE = "​‌‍‎‏­﻿⁠⁡⁢⁣⁤᠎"
LOOK_ALIKE_FROM = "аеорсухіјһѕвнтмАВЕКМНОРСТХαορεΑΒΕΚΜΝΟΡΤΧᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ"
LOOK_ALIKE_TO = "aeopcyxijhsbhtmABEKMHOPCTXaopeABEKMNOPTXabcdefghijklmnoprstuvwyz"

# Weight of each check in the score, in the order in which they are summed.
WEIGHTS = {"vocabulary": 0.08, "phrases": 0.05, "structure": 0.07, "formatting": 0.00, "tone": 0.15, "compression": 0.20, "sentence_rhythm": 0.15, "punctuation": 0.12, "connectives": 0.10, "burstiness": 0.08}
# The order of display, and the names of the sections and of the summary.
DISPLAY_ORDER = ["compression", "sentence_rhythm", "tone", "punctuation", "connectives", "burstiness", "vocabulary", "structure", "phrases", "formatting"]
SECTIONS = {"vocabulary": "Banned Vocabulary", "phrases": "Banned Phrases", "structure": "Sentence & Paragraph Structure", "formatting": "Formatting", "tone": "Tone", "compression": "Compression Analysis", "sentence_rhythm": "Sentence Rhythm", "punctuation": "Punctuation Diversity", "connectives": "Connective Density", "burstiness": "Word Burstiness"}
SUMMARY_NAMES = {"vocabulary": "Vocab", "phrases": "Phrases", "structure": "Structure", "formatting": "Format", "tone": "Tone", "compression": "Compression", "sentence_rhythm": "Rhythm", "punctuation": "Punct", "connectives": "Connectives", "burstiness": "Burstiness"}


def inflected_forms() -> dict[str, str]:
    """Every form that a suffix makes of a listed word, and the word: the first suffix in order decides, the bare stem before stem and e."""
    listed = set(SINGLE_WORDS)
    forms: dict[str, tuple[int, int, str]] = {}
    for word in SINGLE_WORDS:
        for rank, suffix in enumerate(SUFFIXES):
            for late, stem in ((0, word), (1, word[:-1] if word.endswith("e") else None)):
                if stem is not None and len(stem) > 2 and (form := stem + suffix) not in listed:
                    forms[form] = min(forms.get(form, (rank, late, word)), (rank, late, word))
    return {form: word for form, (_, _, word) in sorted(forms.items())}
