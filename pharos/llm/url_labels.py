"""The labelled URLs of the URL filter: 0 is a page worth keeping, 1 one that is not.

Bad URLs are link farms, redirects, session and tracking copies, crawler traps, login and cart pages,
random hosts, and files that aren't text. Names are invented.
"""

GOOD = """
https://www.harborgazette.example.com/2021/05/city-council-votes-on-new-library
https://news.northfield.example.org/en/science/how-bees-find-their-way
https://en.wikilike.example.org/wiki/Suffix_tree
https://docs.toolbox.example.net/guide/installation
http://www.gardenersclub.example.com/articles/pruning-roses
https://blog.anna-lind.example.com/en/412
http://bergwacht.example.de/bericht/lawine-am-hang
https://www.uni-sued.example.de/fakultaet/physik/vorlesungen.html
https://revue.lettres.example.fr/articles/proust-et-le-temps
http://cocina.abuela.example.es/recetas/tortilla-de-patatas.html
https://www.cityarchive.example.org/collections/maps/1850
https://journal.marine.example.org/volume/12/issue/3
https://m.dailyreader.example.com/en/98
http://thebakery.example.com/en/328/
https://recipes.simple.example.net/bread/rye
https://www.museum.example.org/exhibitions/2019/summer
https://forum.woodwork.example.com/thread/dovetail-joints
https://lecture-notes.example.edu/algebra/chapter2
http://www.traveldiary.example.net/en/297
https://history.town.example.org/people/mayors
https://poems.example.org/keats/ode-to-autumn
https://www.healthline-like.example.com/sleep/how-much-is-enough
http://blog.meadow.example.org/de/945.html
https://birds.example.org/species/wren
https://kids.example.com/stories/the-owl
https://essay.example.net/en/on-writing
http://radio.example.fr/emissions/matin
https://www.gazette.example.es/es/918
https://stadtblatt.example.de/de/712.html
http://www.hills.example.com/fr/748
https://tales.example.com/en/10
https://library.example.org/fr/25/
https://www.theatre.example.net/de/20
http://lakeside.example.org/es/249/
https://chess.example.com/openings/sicilian
https://astro.example.org/planets/saturn/rings
https://cook.example.net/soups
https://law.example.edu/cases/1971
https://m.gardens.example.com/es/304
http://paper.example.com/opinion/letters
""".split()

BAD = """
http://win-free-prize-4u.example.xyz/claim.php?id=88213&ref=aff92&sid=9f8e7d6c5b
http://x7k2q9vz.example.top/a8f3k2/d9w1/index.php?s=29381
https://cheap-pills-online-best-price.example.biz/buy/now/?ref=mail&utm_source=spam&utm_campaign=q3
http://198.51.100.23/~user/login.php?session=8a7d6f5e4c3b2a1908
https://track.clicks.example.info/r?u=https%3A%2F%2Fshop.example.com%2F%3Fa%3D1&c=9281&k=ffa02
http://calendar.example.com/view?date=2031-04-17&month=4&year=2031&mode=day&next=1
https://shop.example.com/cart?action=add&item=99812&qty=1&sessionid=7fae1200bd
https://www.example.com/search?q=a&page=981&sort=price&order=desc&filter=red
http://mirror.example.net/files/archive_2019_full.tar.gz
http://cdn9.example.net/img/8f7a6b5c4d3e2f10_large.jpg
https://login.secure-update-account.example.info/verify/index.html?token=aa81bc92dd73
http://casino-bonus-777-slots.example.top/play?aff=7781
https://pics.example.com/gallery/img_0012931.png?size=1024x768&download=1
http://a.b.c.d.e.example.xyz/1/2/3/4/5/6/7/8/9/10
https://www.example.com/print?id=5512&print=1&PHPSESSID=0a9b8c7d6e5f4a3b2c1d
http://seo-links-buy-cheap.example.biz/dir/links-page-88.html?p=88&cat=22
https://ads.example.net/banner?zone=12&size=728x90&cb=19283746&u=9912
http://qzxvbnmlkjh.example.top/wp-content/uploads/2020/11/x.exe
https://bit.example.info/3Fk9ZqX?x=1
http://forum.example.com/member.php?action=register&ref=771&s=b1946ac92492d2347c6235b4d2611184
https://t.example.info/c/8831?e=ZmFrZUBleGFtcGxlLmNvbQ%3D%3D&r=1&l=77
http://video.example.com/embed?v=dQw4w9&autoplay=1&mute=1&loop=1&list=PL8812
https://hotel-deals-last-minute-cheap.example.xyz/book?in=20240101&out=20240103&rooms=2&ref=zz9
http://203.0.113.9:8080/admin/index.php?lang=en&theme=3
https://download.example.biz/setup_v10.4.22_x64.zip?mirror=3
http://www.example.com/index.php?option=com_content&view=article&id=312&Itemid=77&tmpl=component
https://feeds.example.com/rss.xml?format=atom&max=500&start=1000
http://redirect.example.top/go.php?url=http%3A%2F%2Fa.example.com%2Fb%3Fc%3D1&h=8812ab
https://loans-fast-approval-24h.example.biz/apply?src=pop&kw=loan+fast&gclid=88fa7712
http://s3cur3-b4nk-l0gin.example.info/confirm?acc=00291882&pin=1
https://shop.example.net/product?id=9918&color=3&size=xl&variant=12&currency=eur&ref=grid
http://8h2k1.example.xyz/8h2k1/8h2k1/8h2k1/8h2k1/8h2k1/
https://api.example.com/v2/items?limit=100&offset=9900&fields=a,b,c&key=1f3870be274f
http://toolbar-free-download.example.top/install.msi?cid=2213
https://www.example.com/tag/a?replytocom=99182&share=twitter&nb=1
http://m.example.biz/?p=3991&cat=12&paged=77&amp=1
https://dating-singles-near-you.example.xyz/signup?aff_id=921&click=77fa09e1
http://static.example.net/js/bundle.8f7a6b5c.min.js?v=20231109
https://tickets.example.com/seat?event=8812&row=12&seat=31&hold=1&t=1699999999
http://essay-writing-cheap-24-7.example.biz/order-now.php?promo=EXTRA50
""".split()


def rows() -> list[tuple[str, int]]:
    return [(u, 0) for u in GOOD] + [(u, 1) for u in BAD]
