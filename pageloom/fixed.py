"""Values the results depend on, stated once.

Everything here is fixed by the two news sites' page templates or by the record
format; none of it is tunable.
"""

# Source tags of the stored record.
SOURCE_A = "Detik.com"
SOURCE_B = "Liputan6.com"

# Channels of site A and their listing pages.  Two channels share
# one address, so the name is the key.
# Address of site B's listing.
INDEX_B = "https://www.liputan6.com/indeks"

CHANNELS = [
    ("News", "https://news.detik.com/indeks"),
    ("Edu", "https://www.detik.com/edu/indeks"),
    ("Finance", "https://finance.detik.com/indeks"),
    ("Hot", "https://hot.detik.com/indeks"),
    ("Inet", "https://inet.detik.com/indeks"),
    ("Sport", "https://sport.detik.com/indeks"),
    ("Oto", "https://oto.detik.com/indeks"),
    ("Travel", "https://travel.detik.com/indeks"),
    ("Sepakbola", "https://sport.detik.com/sepakbola/indeks"),
    ("Food", "https://food.detik.com/indeks"),
    ("Health", "https://health.detik.com/indeks"),
    ("Jatim", "https://www.detik.com/jatim/indeks"),
    ("Jateng", "https://www.detik.com/jateng/indeks"),
    ("Jabar", "https://www.detik.com/jabar/indeks"),
    ("Sulsel", "https://www.detik.com/sulsel/indeks"),
    ("Sumut", "https://www.detik.com/sumut/indeks"),
    ("Bali", "https://www.detik.com/bali/indeks"),
    ("Hikmah", "https://www.detik.com/hikmah/indeks"),
    ("Sumbagsel", "https://www.detik.com/sumbagsel/indeks"),
    ("Properti", "https://www.detik.com/sumbagsel/indeks"),
    ("Jogja", "https://www.detik.com/jogja/indeks"),
    ("Pop", "https://www.detik.com/pop/indeks"),
]

# Article kinds of each site.
KIND_A_SINGLE = "singlepage"
KIND_A_PHOTO = "multiplefoto"
KIND_A_VIDEO = "video"
KIND_B_TEXT = "Article"
KIND_B_VIDEO = "Video"
KIND_B_PHOTO = "Photo"

# Content block types.
SECTION = "section-title"
PARAGRAPH = "paragraph-text"
IMAGE = "image"
VIDEO = "video"
REFERENCE = "referenced-article-link"
PUBLISHED_FROM = "published-from"

# Reasons for pages left out by their HTTP status.
NOT_FOUND_A = "news not found"
FETCH_ERROR_A = "error fetching news items: "
FETCH_ERROR_B = "error requesting resource: got {status} status code"

# Listing template, site A.
A_LIST_ROOT_ID = "indeks-container"
A_LIST_IMAGE = "media__image"
A_LIST_SUBTITLE = "media__subtitle"
A_LIST_TITLE = "media__title"
A_LIST_LINK = "media__link"
A_LIST_DATE = "media__date"
A_LIST_TIME_ATTR = "d-time"

# Article template, site A.
A_META_KIND = "articletype"
A_META_AUTHOR = "author"
A_META_DURATION = "duration"
JSON_LD = "application/ld+json"
A_JSON_NEWS = r'"@type"\s?:\s?"NewsArticle"'
A_BODY = "detail__body-text itp_bodycontent"
A_HEADLINE_IMAGE = "detail__media-image"
A_IMAGE = "pic_artikel_sisip"
A_REFERENCE = "lihatjg"
A_EMBED = "embed video20detik"
A_DETAIL = "detail"
A_PHOTO_HEADER = "detail__header"
A_PHOTO_SLIDER_ID = "slider-foto__detail"
A_RELATED_ID = "bt_tkt"
A_RELATED_TITLE_ATTR = "dtr-ttl"

# Listing template, site B.
B_LIST_ROOT = "main"
B_LIST_ITEM = "articles--rows--item"
B_LIST_THUMBNAIL = "articles--rows--item__figure-thumbnail"
B_LIST_TITLE = "articles--rows--item__title"
B_LIST_SUMMARY = "articles--rows--item__summary"

# Article template, site B.
B_BODY_TEXT = "articles show category-news immersive"
B_BODY_PHOTO = "articles show category-photo immersive"
B_PUBLISHED = "article:published_time"
B_UPDATED = "article:modified_time"
B_MAIN = "hentry main"
B_CONTENT = "read-page--content"
B_TOP_MEDIA = "read-page--top-media"
B_FIGURE = "read-page--photo-gallery--item"
B_FIGURE_LINK = "read-page--photo-gallery--item__link"
B_ARTICLE_BODY = "article-content-body article-content-body_with-aside"
B_PAGE_ITEM = r"^article-content-body__item-page"
B_SKIPPED = ["advertisement-text", "promo promo-above", "promo promo-below"]
B_IMAGE = "article-content-body__item-media"
B_SECTION = "article-content-body__item-title"
B_CAPTION_STRIP = "<>p/"
B_RELATED_ID = "related-news"
B_RELATED_ITEM = "relateds-slow--lattice--item"
B_SLIDER = "read-page--photo-tag--slider__top js-top-slider"
B_AUTHOR_ID = "rich-card"
