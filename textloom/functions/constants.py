"""Patterns, affixes and symbols of the English defaults."""

#: Tokens kept whole: dotted abbreviations, and a capital with one or two letters and a stop.
SPECIAL = r"^(?:[A-Za-z]\.){2,}\z|^[A-Z][a-z]{1,2}\.\z"
CONTRACTIONS = ("'ll", "'s", "'re", "'m", "n't")
SUFFIXES = (",", ")", '"', "]", "!", ";", ".", "?", ":", "'")
PREFIXES = ("$", "(", '"', "[")
EMOTICONS = (
    "(-8", "(-;", "(-_-)", "(._.)", "(:", "(=", "(o:", "(¬_¬)", "(ಠ_ಠ)", "(╯°□°）╯︵┻━┻", "-__-", "8-)", "8-D", "8D",
    ":(", ":((", ":(((", ":()", ":)))", ":-)", ":-))", ":-)))", ":-*", ":-/", ":-X", ":-]", ":-o", ":-p", ":-x", ":-|",
    ":-}", ":0", ":3", ":P", ":]", ":`(", ":`)", ":`-(", ":o", ":o)", "=(", "=)", "=D", "=|", "@_@", "O.o", "O_o", "V_V",
    "XDD", "[-:", "^___^", "o_0", "o_O", "o_o", "v_v", "xD", "xDD", "¯\\(ツ)/¯",
)
#: Tags that follow from the word's form.
NONE_WORD = r"^(?:0|\*[\w?]\*|\*\-\d{1,3}|\*[A-Z]+\*\-\d{1,3}|\*)\z"
KEPT_WORD = r"^\-[A-Z]{3}\-\z"
#: Ends and insides of tokens that end a sentence.
ENDERS = ('."', ".)", ".’", ".”", "?", '?"', "?'", "?)", "?’", "?”", "!", '!"', "!'", "!)", "!’", "!”")
INNER_ENDERS = (".[", ".(", '."', "?[", "?(", "![", "!(")
NEVER_END = "Yahoo!"
ABBREVIATION = r"(?:\w\.)+\w*\."
ELLIPSIS = r"(?:\.\s?){2,}\."
EXTRA_ABBREVIATIONS = ("sgt", "gov", "no", "mt")
#: Features of the entity recogniser, in order.
FEATURES = (
    "bias", "en-wordlist", "nextpos", "nextword", "pos", "pos+prevtag", "prefix3", "prevpos", "prevtag", "prevword",
    "shape", "shape+prevtag", "suffix3", "word", "word+nextpos", "word.lower", "wordlen",
)
