"""Names of HTML elements and of page parts: fixed values."""

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title svg math iframe object canvas select textarea audio video map".split())
#: Of these, elements whose content is raw: without an end tag it goes on to the end of the page.
RAW = frozenset("script style title textarea noscript iframe".split())
#: Elements that do not part a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag of a kind closes, if it is open in the nearest container.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}

#: Names that page makers give the parts of a page, for the invented pages the labeller learns from.
MAIN_NAMES = "content main article post entry story body text post-content entry-content article-body main-content page-content".split()
MENU_NAMES = "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs pagination tabs".split()
HEAD_NAMES = "header masthead site-header top topbar branding banner".split()
FOOT_NAMES = "footer site-footer bottom colophon copyright legal".split()
SIDE_NAMES = "sidebar aside widget related trending popular tags archive side-column recommended".split()
NOTICE_NAMES = "cookie cookie-notice cookie-banner consent gdpr notice alert paywall modal popup".split()
ADVERT_NAMES = "ad ads advert advertisement sponsored promo ad-slot banner-ad adsense".split()
FORM_NAMES = "newsletter subscribe signup search search-form login contact-form".split()
COMMENT_NAMES = "comments comment comment-list reader-comments discussion replies responses disqus".split()
SHARE_NAMES = "share social share-buttons social-links author-bio".split()
