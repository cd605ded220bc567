"""Word lists used by text normalisation."""

from __future__ import annotations

# The English stop words, plus the stray "l".
STOP_WORDS: tuple[str, ...] = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
l
""".split())

# Contractions and what they stand for, in the order they are applied. "you'll" is
# written with both l's; everything else is as stated.
CONTRACTIONS: tuple[tuple[str, str], ...] = tuple(tuple(row.strip().split(" = ")) for row in """
ain't = am not
aren't = are not
can't = cannot
can't've = cannot have
'cause = because
could've = could have
couldn't = could not
couldn't've = could not have
didn't = did not
doesn't = does not
don't = do not
em' = them
'em = them
hadn't = had not
hadn't've = had not have
hasn't = has not
haven't = have not
he'd = he would
he'd've = he would have
he'll = he will
he'll've = he will have
he's = he is
how'd = how did
how'd'y = how do you
how'll = how will
how's = how is
i'd = i would
i'd've = i would have
i'll = i will
i'll've = i will have
i'm = i am
i've = i have
isn't = is not
it'd = it had
it'd've = it would have
it'll = it will
it'll've = it will have
it's = it is
let's = let us
ma'am = madam
mayn't = may not
might've = might have
mightn't = might not
mightn't've = might not have
must've = must have
mustn't = must not
mustn't've = must not have
needn't = need not
needn't've = need not have
o'clock = of the clock
oughtn't = ought not
oughtn't've = ought not have
shan't = shall not
sha'n't = shall not
shan't've = shall not have
she'd = she would
she'd've = she would have
she'll = she will
she'll've = she will have
she's = she is
should've = should have
shouldn't = should not
shouldn't've = should not have
so've = so have
so's = so is
that'd = that would
that'd've = that would have
that's = that is
there'd = there had
there'd've = there would have
there's = there is
they'd = they would
they'd've = they would have
they'll = they will
they'll've = they will have
they're = they are
they've = they have
to've = to have
wasn't = was not
we'd = we had
we'd've = we would have
we'll = we will
we'll've = we will have
we're = we are
we've = we have
weren't = were not
what'll = what will
what'll've = what will have
what're = what are
what's = what is
what've = what have
when's = when is
when've = when have
where'd = where did
where's = where is
where've = where have
who'd = who had
who'll = who will
who'll've = who will have
who's = who is
who've = who have
why's = why is
why've = why have
will've = will have
won't = will not
won't've = will not have
would've = would have
wouldn't = would not
wouldn't've = would not have
y'all = you all
y'alls = you alls
y'all'd = you all would
y'all'd've = you all would have
y'all're = you all are
y'all've = you all have
you'd = you had
you'd've = you would have
you'll = you will
you'll've = you will have
you're = you are
you've = you have
m'lord = my lord
m'lady = my lady
d'you = do you
""".strip().splitlines())

# Contractions whose spaced-out spelling is not simply the
# apostrophe turned into a space between two spaces.
SPACED_EXCEPTIONS = {
    "'cause": None, "em'": None, "'em": " em ", "don't": " don't ",
    "shan't": " shan t", "sha'n't": " sha n t",
}

# Residual spellings rewritten after the contractions.
RESIDUAL_RULES: tuple[tuple[str, str], ...] = (
    (" g'", " good "), (" m'", " my "), (" d'", " do "), (" s ", "s "),
)

# Words the word tokenizer always splits in two.
SPLIT_WORDS = {
    "cannot": ("can", "not"), "gimme": ("gim", "me"), "gonna": ("gon", "na"),
    "gotta": ("got", "ta"), "lemme": ("lem", "me"), "wanna": ("wan", "na"),
}

# English number names.
ONES = """zero one two three four five six seven eight nine ten eleven twelve
thirteen fourteen fifteen sixteen seventeen eighteen nineteen""".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = """thousand million billion trillion quadrillion quintillion sextillion septillion
octillion nonillion decillion""".split()
NUMBER_DIGITS = 3 * (len(SCALES) + 1)


def spaced_rules() -> list[tuple[str, str]]:
    """The same contractions, in the same order, where a space has taken the apostrophe's place.

    Every rule keeps a blank on both sides of what it writes.
    """
    rules = []
    for short, full in CONTRACTIONS:
        pattern = SPACED_EXCEPTIONS.get(short, " " + short.replace("'", " ") + " ")
        if pattern is not None:
            rules.append((pattern, f" {full} "))
    return rules


def apostrophe_rules() -> list[tuple[str, str]]:
    return list(CONTRACTIONS)
