from factloom.llm import chat


def test_loss_behind_an_opening():
    """A template that begins the conversation with something doesn't shift the spans of later turns."""

    def opened(turns):
        return "<begin>You are helpful.\n" + "".join(f"[{r}]{t}x|" for r, t in turns)

    turns = [("assistant", "hello"), ("user", "q"), ("assistant", "the whole answer"), ("user", "r"), ("assistant", "xx")]
    made = chat.format_conversation(turns, opened, lambda output: [])
    assert made["rewrites"] == []
    assert [made["output"][a:b] for a, b in made["loss_spans"]] == ["hello", "the whole answer", "xx"]


def test_loss_of_a_template_that_escapes_nothing():
    """What undoes the escapes comes with the template: here a backslash is a backslash."""

    def bare(turns):
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns)

    made = chat.format_conversation([("user", "q"), ("assistant", "a\\hb")], bare, lambda output: [], plain=str)
    assert made["loss_chars"] == 4
