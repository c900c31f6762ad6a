from quarry.llm.html_text import main_text

STORY = "".join(f"<p>Sentence {k}, with some words in it. And another one, too, of the story.</p>" for k in range(7))
LEAD = "".join(f"<p>Opening {k}, with some words in it. And another one, too, of the lead.</p>" for k in range(3))


def test_lead_beside_the_story_stays_without_an_article_element():
    text = main_text(f"<body><div><div>{LEAD}</div><div>{STORY}</div></div></body>")
    assert text.count("Opening") == 3 and text.count("Sentence") == 7
    nested = main_text(f"<body><div>{LEAD}</div><div><div>{LEAD}</div><div>{STORY}</div></div></body>")
    assert nested.count("Opening") == 6 and nested.count("Sentence") == 7


def test_linked_paragraph_and_item_of_an_article_stay():
    page = f"<article>{STORY}<p><a href=x>The linked source</a></p><ul><li><a>One</a><li><a>Two</a></ul></article>"
    assert main_text(page).endswith("The linked source\n\nOne\n\nTwo")


def test_single_link_stays_and_link_list_goes_outside_an_article():
    assert "See here" in main_text(f"<div>{STORY}<p><a>See here</a></p>{STORY}</div>")
    text = main_text(f"<div>{STORY}<ul><li><a>One</a><li><a>Two</a></ul><p><a>A</a> <a>B</a></p></div>")
    assert text.count("Sentence") == 7 and "One" not in text and "Two" not in text and "A B" not in text
