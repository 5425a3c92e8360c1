"""English passages that the catalogue's queries append to the provided texts, whose invented prose holds no English cues: the
one of a document is chosen by its doc_id, the same in the queries and in their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first one is empty, so that some texts stay as they are.
PASSAGES = [
    "",
    """This essay will argue that the island shows how power and authority corrupt society. Why does order matter so much?
Furthermore, Golding foregrounds the tension between civilisation and chaos; he illuminates the fragility of justice. The narrator says "the world was going mad" to the boys (12). This suggests that human nature is flawed. The conch symbolises order, which reveals the collapse of every institution. Ultimately, society depends on a shared morality.
However, some readers might argue that the ending offers hope. According to the novel, "we did everything adults would do" (p. 45). This shows that freedom without structure becomes violence. Perhaps the contrast between light and darkness means that reason is weak.
In conclusion, the novel serves as a powerful reminder of the human condition. It is not only a warning but also a prayer.""",
    """I think the story is very important because it doesn't hide its meaning. I don't really like the ending, but my view isn't final.
It is important to note that the author uses imagery: the sea is cold, grey and empty. For example, the text says "nothing beside remains" (3). This means that power is lost. Therefore the image represents the passing of authority.
For instance, when Jack sees the fire he could run away. The critic wrote "a parable of fear" in 1954. Such symbolism suggests an epistemological doubt – perhaps nothing can be known. More broadly, humanity is afraid of truth.
While the opening is calm, the climax is ultimately brutal. It clearly must be read twice; it never fails (as many say).""",
    """In this essay I will discuss two poems. They may differ, although both explore identity.
Moreover, the poet juxtaposes "the quiet room" with "a roaring street" throughout the poem. This contrast highlights the conflict between freedom and duty because the speaker is divided. The structure reinforces that tension, and the diction evokes loss.
On the other hand, critics read the poem as a love song. The word "home" is repeated and "the long way home" returns (21). This repetition suggests that memory is unreliable. Thus the motif conveys what it means to belong to a society.
At first glance the tone is sad, yet it is not entirely bleak. Overall, the poems interrogate justice and underscore the paradox of freedom.""",
    """The author shows a city, tells a story and explains a life. It was written in 1851, during the industrial era.
Similarly, the chapter describes the mill: smoke, noise, and iron. The foreman says, "there is work for all" (7). The manager said, "no one leaves before ten" (8). This implies that labour is a system of discipline. Consequently, the worker becomes a part of the machine.
Another example is the letter. The mother wrote "be good and be quiet" before she died. It reveals how families shape obedience, since authority begins at home. Some readers may suggest that she is simply afraid.
Finally, today we still live with such institutions. The theory of discourse, a framework for research, analyses this hierarchy. Isn't that striking?""",
    """Anna walks home. She meets Peter. He gives her a book.
Also, Anna reads the first page and laughs. Peter looks at the river. Then they go to the old mill.
Another day begins; rain falls. Anna was given a coat by her aunt. The coat, being heavy, is left behind. Walking slowly, she thinks of "a very small house" by the sea.
i think alot of people definately like this story. It is good, great, interesting and powerful.""",
    """I argue that hope is fragile. The novel was published in 1960, at the time of great change.
First, the protagonist is described as "a man of no words" (4). This shows that silence is power. Arguably, it also complicates the idea of courage. The silence, in part, represents an ideology.
Secondly, the town states "we keep our own" (19). This reveals that a society protects its order. However, this order is partly a construct. It could be argued that the law is silent as well.
Thirdly the judge writes "the law is blind" (30). That suggests that justice is an ideal; nevertheless, people need it. Universal truths are rare, and human nature is ambiguous.
In summary, the reader can therefore see that courage means acting although fear remains. This is a timeless lesson and remains relevant today.""",
    """It is worth noting that silence – real silence – is rare. This allows the reader to pause.
Furthermore, silence is not simply absence. Notably, the composer uses "a single held note" (2). This demonstrates restraint. The pause illustrates the dialectic of sound and nothing, and it exposes our condition.
Additionally, the audience may become restless. In contrast, the players wait. The programme states "listen to the room" in large type. Here the instruction emphasises that the room is an instrument. Hence the wider implication is that a collective listens.
To conclude, the piece subverts habit; it destabilizes the system of applause, and it problematizes the concert.""",
]


def with_passage(text: Column, doc_id: Column) -> Column:
    """A text (null: empty) and its passage."""
    chosen = F.element_at(F.array(*[F.lit(("\n" if p else "") + p) for p in PASSAGES]), (F.pmod(doc_id, F.lit(len(PASSAGES))) + 1).cast("int"))
    return F.concat(F.coalesce(text, F.lit("")), chosen)


def sql(text: str = "text", doc_id: str = "doc_id") -> str:
    """The same in SQL."""
    quoted = ["'" + (("\n" if p else "") + p).replace("'", "''") + "'" for p in PASSAGES]
    return f"coalesce({text}, '') || ([{', '.join(quoted)}])[{doc_id} % {len(PASSAGES)} + 1]"
