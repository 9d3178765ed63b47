"""Small labelled English text, from which the default model is trained: written for this
package, no more than a start; train on own data with plans.fit for anything real."""

#: Lines of word/TAG items, tags of the Penn Treebank.
TAGGED = """
The/DT old/JJ man/NN walked/VBD to/TO the/DT small/JJ house/NN ./.
She/PRP quickly/RB opened/VBD the/DT red/JJ door/NN and/CC smiled/VBD ./.
Anna/NNP lives/VBZ in/IN Paris/NNP with/IN her/PRP$ two/CD dogs/NNS ./.
They/PRP are/VBP reading/VBG books/NNS about/IN the/DT sea/NN ./.
He/PRP will/MD visit/VB London/NNP next/JJ week/NN ./.
Where/WRB did/VBD you/PRP find/VB that/DT key/NN ?/.
It/PRP is/VBZ very/RB cold/JJ today/NN ,/, but/CC the/DT sun/NN shines/VBZ ./.
The/DT company/NN sold/VBD 300/CD cars/NNS in/IN 2019/CD ./.
We/PRP have/VBP never/RB seen/VBN such/JJ a/DT beautiful/JJ garden/NN ./.
John/NNP and/CC Mary/NNP were/VBD singing/VBG loudly/RB ./.
You/PRP should/MD n't/RB eat/VB those/DT green/JJ apples/NNS ./.
The/DT children/NNS played/VBD in/IN the/DT park/NN until/IN night/NN ./.
My/PRP$ brother/NN works/VBZ for/IN a/DT large/JJ bank/NN in/IN Berlin/NNP ./.
Who/WP wrote/VBD this/DT letter/NN ?/.
Prices/NNS rose/VBD by/IN five/CD percent/NN last/JJ year/NN ./.
I/PRP can/MD help/VB you/PRP if/IN you/PRP want/VBP ./.
There/EX is/VBZ a/DT book/NN on/IN the/DT table/NN ./.
Robert/NNP has/VBZ been/VBN waiting/VBG for/IN three/CD hours/NNS ./.
The/DT president/NN of/IN France/NNP spoke/VBD slowly/RB ./.
Dogs/NNS usually/RB like/VBP to/TO run/VB ./.
""".strip()

#: (text, labelled parts of it)
ENTITIES = (
    ("Anna lives in Paris.", (("Anna", "PERSON"), ("Paris", "GPE"))),
    ("We met Robert in London.", (("Robert", "PERSON"), ("London", "GPE"))),
    ("Mary went to Berlin with John.", (("Mary", "PERSON"), ("Berlin", "GPE"), ("John", "PERSON"))),
    ("The children played in the park.", ()),
    ("He flew from Rome to Madrid.", (("Rome", "GPE"), ("Madrid", "GPE"))),
    ("Peter Smith wrote a letter.", (("Peter Smith", "PERSON"),)),
    ("The company sold cars in France.", (("France", "GPE"),)),
    ("Clara saw the sea.", (("Clara", "PERSON"),)),
)
