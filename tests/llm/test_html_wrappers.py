"""Pages whose wrapper bears a word or tag of parts that count for nothing."""

import pytest

from cadenza.llm import html_text

BODY = "".join(f"<p>{'Plain words of a long paragraph without links. ' * 5}</p>" for _ in range(4))
MENU = "<div class=menu>" + "".join(f"<a href=/{i}>menu entry {i}</a>" for i in range(20)) + "</div>"
WRAPPERS = ["<form id=aspnetForm>", "<div id=content-sidebar-wrap>", "<div class=sidebar-right>", "<div class='layout-sidebar'>", "<div class=search-results>", "<section class=widget>", "<div class=overlay>", "<div role=dialog>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrapper_is_a_plain_block(wrapper, inner):
    end = f"</{wrapper[1:].split()[0].rstrip('>')}>"
    text = html_text.extract(f"<body>{wrapper}{MENU}<{inner}>{BODY}</{inner}><div class=footer>All rights reserved</div>{end}</body>")
    assert text.count("Plain words") == 20 and "menu" not in text and "rights" not in text


def test_long_comments_beside_an_article_stay_out():
    comments = "<div class=comments>" + "<article class=comment><p>Some comment on it.</p></article>" * 200 + "</div>"
    text = html_text.extract(f"<body><article>{BODY}</article>{comments}</body>")
    assert text.count("Plain words") == 20 and "comment" not in text


def test_marked_parts_are_taken_if_nothing_else_is_left():
    assert html_text.extract("<body><aside>one</aside><footer>two</footer><script>x()</script></body>") != ""
