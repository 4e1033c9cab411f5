"""Pages of layouts that are not those of the made-up pages, with the blocks of their main text."""

P1='For many years the old lighthouse stood empty above the bay, and nobody in the village could say who owned it. Last spring the council sold it, for a single coin, to a teacher from the city.'
P2='She plans to open it to visitors in June, once the stairs are safe. The lamp itself, made in 1887, will be lit again on the first night.'
P3='Until then the path is closed. Walkers should take the lower road, which is signposted from the harbour.'
PAGES = {
"blog": (f'<body class="home page"><div id="page"><div class="site-branding"><a href="/">Coast Notes</a></div><div class="menu-main-container"><ul id="menu"><li class="menu-item"><a href="/a">About</a></li><li class="menu-item"><a href="/b">Archive</a></li></ul></div><div class="entry-content"><h1>The lighthouse is sold</h1><p>{P1}</p><p>{P2}</p><blockquote><p>{P3}</p></blockquote><div class="sharedaddy share-buttons"><a href="#">Tweet</a> <a href="#">Mail</a></div></div><div id="comments" class="comments-area"><h2>3 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely news, thank you for this. I grew up there.</p></li><li class="comment"><p>Who is the teacher? We would like to help.</p></li></ol></div><div class="widget-area sidebar"><h3>Recent</h3><ul><li><a href="/1">Storm in the bay</a></li><li><a href="/2">New ferry</a></li></ul></div><div id="colophon" class="site-footer">Copyright 2024 Coast Notes. All rights reserved.</div></div></body>', ["The lighthouse is sold",P1,P2,P3]),
"plain_div": (f'<html><body><div><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div><div><h1>The lighthouse is sold</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div>&copy; 2024 Bay Press</div></div></body></html>', ["The lighthouse is sold",P1,P2,P3]),
"docs": (f'<body><nav aria-label="Main"><ul><li><a href="/">Docs</a></li><li><a href="/api">API</a></li></ul></nav><div class="toc sidebar"><ul><li><a href="#a">Setup</a></li><li><a href="#b">Use</a></li></ul></div><main role="main"><h1>Setting up the lamp</h1><p>{P1}</p><h2 id="a">Setup</h2><ul><li>Open the lower door and switch on the pump, then wait a minute.</li><li>Climb to the lamp room and clean both lenses with soft paper.</li></ul><pre>lamp --start\nlamp --check</pre><p>{P2}</p></main><footer><p>Built with care. <a href="/legal">Legal</a></p></footer></body>', ["Setting up the lamp",P1,"Setup","Open the lower door and switch on the pump, then wait a minute.","Climb to the lamp room and clean both lenses with soft paper.","lamp --start lamp --check",P2]),
"table": (f'<body><table><tr><td colspan=2><font size=5>Bay Press</font></td></tr><tr><td><a href="/">Home</a><br><a href="/n">News</a><br><a href="/s">Sport</a></td><td><h1>The lighthouse is sold</h1><p>{P1}<p>{P2}<p>{P3}</td></tr></table></body>', ["The lighthouse is sold",P1,P2,P3]),
"button": (f'<body><header><a href="/">Bay Press</a></header><article><h1>The lighthouse is sold</h1><button>Save<p>{P1}</p><p>{P2}</p><p>{P3}</p></article></body>', ["The lighthouse is sold",P1,P2,P3]),
"inline": (f'<body><noscript><p>Please turn on JavaScript.</p></noscript><article><h1>The lighthouse is sold</h1><p>{P1} <button>Copy</button> {P2}</p><video src=x>Your browser has no video.</video><p>{P3}</p></article><template><p>Hidden draft of a card.</p></template></body>', ["The lighthouse is sold",P1+" "+P2,P3]),
"consent": (f'<body><div id="cookie-banner" class="cc-window"><p>We use cookies to make this site work and to count visits. You can refuse them at any time.</p><button>Accept</button></div><div class="container"><div class="row"><section class="story"><h1>The lighthouse is sold</h1><div>{P1}</div><div>{P2}</div><div class="advertisement"><p>Boats for hire, every day from nine. Call us now.</p></div><div>{P3}</div></section><aside><h4>Related</h4><a href="/1">Storm in the bay</a></aside></div></div></body>', ["The lighthouse is sold",P1,P2,P3]),
"form": (f'<body><div class="search"><form><input><button>Search</button></form></div><main><article class="post hentry"><header class="entry-header"><h1 class="entry-title">The lighthouse is sold</h1></header><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><div class="newsletter-signup"><p>Get our letter every Friday. No spam, ever.</p><form><input><button>Join</button></form></div></main></body>', ["The lighthouse is sold",P1,P2,P3]),
}
