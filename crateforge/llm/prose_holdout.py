"""Hand-checked holdout: short texts, 1 for not prose and 0 for prose.

Written in the manner of the corpus, and documents of the test data drawn by the
hash of their id (of up to 230 characters, to keep this file small) and read one by
one. The written ones train; every second one of the drawn documents calibrates,
the others only test.
"""

_PROSE = (
    "The second side came back after years of silence.",
    "Her voice carries the whole record, and the drummer stays behind it. I would not change a note of this edition.",
    "could you add old river by ann lee to the list please... the drummer never settles down but i like it",
    "thanks, the folder arrived and all the tracks are there\nthe bot told me it was already in the library",
    "> The first pressing was cut too loud for my taste.\n> The reissue is better, and it holds the songs together.",
    "The label takes a few listens to open up, and a friend from the\nshop said it was missing from the folder. The whole record skips\nnear the end of the third track without any fuss.",
    "Die letzte Suite klingt wärmer, als ich dachte, denn das Beiheft musste von Hand beschriftet werden. Trotzdem bleibt sie am Ende zu kurz.",
    "Le second disque demande plusieurs écoutes pendant neuf minutes. L’édition numérique ne se pose jamais vraiment si on lui laisse le temps.",
    "El coro todavía me da escalofríos en mi opinión. Es de 2021 y el sello mejora cada vez que la pongo en casa.",
    "Ce soir, Ann Lee, Marc Dorval, Les Hautes Eaux et Jean Tremel ont joué avant Les Années de Verre, et la salle était pleine.",
    "THE SINGER WAS NEVER IN A HURRY. IT WAS MADE IN A SINGLE WEEK AND IT SHOWS IN THE BEST WAY.",
    "1. Old River (3:20)\n2. Long Road (4:11)\n\nIt was made in 1978 and this reissue still gives me chills. As for the sound, the remaster leaves a lot of space between the notes, and my copy has no noise at all on the second side of the record.",
    "Ich suche das Album, es war auf meiner alten Platte und ist jetzt weg? Hat es jemand in einer besseren Fassung als ich, bitte melden",
    "Q: Does anyone have this in a better version than mine?\nA: The one in the library is from the old tape, so it will not get better than that.",
    "On the other hand, the closing suite was mixed by somebody with a steady hand. To be fair, the bass line takes a few listens.\n\n- Slow Water\n- Old Street\n- Another Rain\n\nLater that year, the new transfer arrived with the wrong sleeve, but it was worth the wait and I still play it at night.",
    "Ann Lee followed it with Old River – Long Road, which never quite settles down. The producer had to be asked twice before the tape was found.",
    "Su voz volvió después de años de silencio y la cara B deja mucho espacio entre las notas, aunque mi ejemplar salta cerca del final de la tercera pista.",
    "merci, le disque est arrivé et toutes les pistes sont là donc je le garde",
    "Good.",
    "I heard it once on the radio and never again.",
)

_JUNK = (
    "artist,album,year,kbps,ok\nAnn Lee,Old River,1999,320,yes\nMarc Dorval,Verre,2001,256,no\nJean Tremel,Pluie,1987,900,",
    "| # | title | length |\n|---|---|---|\n| 1 | Old River | 8:07 |\n| 2 | Long Road | 3:08 |\n| 3 | Slow Water | 7:05 |",
    "01. Old River (6:27)\n02. Long Road (4:17)\n03. Slow Water (7:00)\n04. Another Rain (5:27)",
    "* the drummer\n* my copy\n* the whole record\n* the label\n* the first pressing\n* the bass line",
    "the drummer\nthe label\nmy copy\nthe drummer\nthe second side\nthe label\nthe producer\nmy copy",
    "the live version: x\nan old cassette of it: -\nthe choir: 1\nthe bonus disc: ok\nthe remaster: -",
    "or\t728\nafter\t1841\na\t1099\nits\t862\nit\t3207\ninto\t2124\ncan\t1220",
    "ne\noù\nces\nque\npas\nleur\nsi\nlui\npas\nces\noù\nce\nque\naussi",
    "2025-08-29T01:00:43 WARN [fill] skip (in-flight)\n2025-01-01T12:33:12 INFO [fill] id:54448 route=PARK rc=2",
    "bits_per_raw_sample=24\nsample_rate=44100\nTRACKNUMBER=3\nDATE=1999\nALBUM=Old River",
    '[{"artist": "Ann Lee", "year": 1963, "files": [{"filename": "Old River", "size": 19135493}, {"filename": "Long Road", "size": 31492606}]}]',
    "Sebu+JsQBbSqxG2+nahpK02Hb5/FgqSLPGzEq9Bv2bkc3+nt9AsZWHFIfrvjwPUrFxqjgTw7\nCaZ5SaWG4KYcTxcF+e6ABaAEouG/sTbzWTafXXPmzbOnFtfWf3/uAh6wsjB+Uh1TCpyUNoyz",
    "9~[(&+.2*&3*?(c#&9-_\\b$] :96*z]|!_[9.y09^xa.-&|yc{[4b9\n%~1_\n2.=*>}yz[%a*5<9@->25}",
    "River !!!. River !!!. River !!!. River !!!. River !!!. River !!!. River !!!. River !!!.",
    "[ ] Ann Lee - Old River\n[x] Marc Dorval - Verre - Part 2\n[ ] Jean Tremel - Pluie\n[ ] Les Hautes Eaux - Un",
    "Ann Lee - Old River\nMarc Dorval - Verre\nJean Tremel - Pluie d’été\nLes Hautes Eaux - Premier\nJohn Marsh - Stone and Sea",
    "This is what is in the folder.\nAnn Lee :: Old River :: Long Road\nMarc Dorval :: Verre :: Pluie\nJean Tremel :: Un :: Deux\n* John Marsh :: Stone :: Sea\nMary Poe :: Light :: Dark",
    "Ann Lee\\1999 - Old River\\01 Long Road.flac\nMarc Dorval\\2001 - Verre\\02 Pluie.flac\nJean Tremel\\1987 - Un\\03 Deux.mp3",
    "<div><ul><li><a href=\"/a/1\">Old River</a></li><li><a href=\"/a/2\">Long Road</a></li></ul></div>",
    "  TRACK 01 AUDIO\n    TITLE \"Old River\"\n    INDEX 01 38:37:48\n  TRACK 02 AUDIO\n    TITLE \"Long Road\"\n    INDEX 01 10:35:41",
    "| 1 | the first pressing | in the end | the whole record |\n| 2 | a friend from the shop | on a good system | the middle of the album |\n| 3 | the rip I found | because the tape was worn | the label |",
    "vinyl, lossless, rip, flac, 24bit, rare, oop, reissue, jazz, soul, mono, stereo, tape, cassette, remaster, live",
    "diese Neuauflage\ndiese Neuauflage\ndiese Neuauflage\ndiese Neuauflage\ndiese Neuauflage\ndiese Neuauflage",
    "http://a.example/x/1\nhttp://a.example/x/2\nhttp://a.example/x/3\nhttp://a.example/x/4",
)

_DRAWN_PROSE = (
    'Es de 1958 y esta reedición suena más cálido de lo que recordaba durante 7 minutos.',
    'Why is Remvimken & Polhalbe still waiting in the queue since last week?',
    'Even so, the bass line never quite settles down. Her voice was never meant to be released, so the second side was cut too loud for my taste.',
    'El disco entero tuvo que etiquetarse a mano, pero la nueva copia suena más cálido de lo que recordaba. The Rossanel Bridges siguió con Badinvim Firrador, que mejora cada vez que la pongo.',
    'Alexander Matemkol followed it with La Forêt Ratolhal – Zimtollin, which keeps its distance from the rest. The second side was recorded in a single week without any fuss.',
    'Halrinyor Collective ließ darauf Größe Wilgennim: Sorselkal folgen,\nund mein Exemplar kommt nie ganz zur Ruhe. Es stammt aus dem Jahr 2010\nund mein Exemplar ist in gutem Zustand schwer zu finden, etwa 8\nMinuten lang.',
    'The Lemfirtem Fires siguió con Themes from "Lornimza Wenfenrem", que sostiene las canciones.',
    'could you add Où dort Wengenpa Pelyanrem ? from The Zimgenyan Orchards to the list please',
    'Does anyone have Été à Tolpirnor, Samidwen by Katherine Bonimdiñ in a better version than mine?',
    'El segundo disco sostiene las canciones al menos con auriculares. En cuanto al sonido, esta reedición volvió después de años de silencio. En cuanto al sonido, la versión en directo nunca termina de calmarse.',
    'alguien tiene разговор с полпелйо калтиртир i de kammerchor firtadin en una versión mejor que la mía… puedes añadir für vimpolzim benelfir de stephen yortirma a la lista por favor',
    'danke, vormidgolとdeltolgolの海, volume 2 ist da und alle stücke sind dabei :)',
    'Nelsadin\xa0Chamber\xa0Ensemble,\xa0Zoé\xa0Wénnimpol\xa0y Dolores Zelsorvim tocaron antes que Ночь Тасортир и Дархинла y Electric Rivers for Selfenhem Kirdelhal.',
    'The digital edition was mixed by somebody with a steady hand when the room is quiet. The engineer was missing from the folder after all these years. An old cassette of it moves slowly but with purpose after all these years.',
    'la versión en directo faltaba en la carpeta al menos con auriculares el segundo disco necesita varias escuchas después de tantos años pelhinkal tirsagen siguió con déjà bonimtem, encore begolyan, que necesita varias escuchas',
    'thanks, what vafendar said to fenzelkol arrived and all the tracks are there\nnobody in the band came back after years of silence for the first ten minutes??',
    'la primera edición sostiene las canciones, pero el segundo disco merece más atención mi ejemplar nunca termina de calmarse por lo que yo sé el cuarteto salta cerca del final de la tercera pista si se le da tiempo',
    'could you add corazón remdinpol zayorlin (deluxe edition) from dj gentemvel-lemnelwen to the list please and the drummer came back after years of silence from start to finish thx',
    'El batería nunca termina de calmarse si se le da tiempo. El sello faltaba en la carpeta si se le da tiempo.\n\nGracias, Dorfalor by Sormidlor Light ha llegado y están todas las pistas.',
    'The choir gets better every time although the notes say otherwise. I\nam looking for RosmidbeとFatembeの海, it was on my old drive and now it\nis gone?\n\nThe engineer feels like a letter to an old friend at least on\nheadphones.',
    'The closing suite holds the songs together, and my copy has a long fade at the end. The digital edition was mixed by somebody with a steady hand, so the whole record never quite settles down.',
    'Various Artists, Søren Pelbohal, The Lemfirtem Fires, The Nelvava Tides and The Nelvava Tides were heard before No Hours in Fanava – Kolvorpol.',
    'The Lemfirtem Fires – Über Nelpahal und Jarvoryor\n\nLa ingeniera de sonido avanza despacio pero con intención, pero la cara B se grabó en una sola semana.\n\n8/10',
    'Es de 2023 y la línea de bajo nunca se pensó para la venta durante 9 minutos. Aun así, el disco entero sostiene las canciones.',
    'Zimhinhin\xa0Fawilma\xa0ließ\xa0darauf\xa0Babora’s\xa0Machines (Tavelros Sessions) folgen, und ihre Stimme wird mit jedem Mal besser. Das Label wurde in einer einzigen Woche aufgenommen, und die Mitte des Albums fehlte im Ordner.',
    'The first pressing deserves more attention as far as I can tell.\nThe remaster was missing from the folder without any fuss. Nobody\nin the band arrived with the wrong sleeve, so the booklet leaves\na lot of space between the notes.',
    'Even so, the rip I found holds the songs together. The string\nsection holds the songs together while the rest of the band\nwaits…',
    'kannst du bitte Où dort Nanorkir Nortahal ? von The Lemfirtem Fires auf die Liste setzen\ndie erste pressung wirkt wie ein brief an eine alte freundin, aber die basslinie klingt wärmer, als ich dachte',
    'Das Label wirkt wie ein Brief an eine alte Freundin. Diese Neuauflage fehlte im Ordner auf einer guten Anlage.\nDie letzte Suite verdient mehr Aufmerksamkeit, und der Chor kommt nie ganz zur Ruhe.',
    'Ihre Stimme lässt viel Raum zwischen den Tönen wenn es im Zimmer still ist. Seltsamerweise, dieser erste Akkord klingt wärmer, als ich dachte.\n\nDer Schlagzeuger hält die Lieder zusammen am Ende.',
    'I am looking for Über Velbajo und Sasorvim, it was on my old drive and now it is gone\non the other hand, the closing suite arrived with the wrong sleeve',
    'Le label devient meilleur à chaque fois du début à la fin. Cette réédition saute vers la fin du troisième morceau au moins au casque. La dernière suite mérite plus d’attention, donc le livret mérite plus d’attention.',
    'It was made in 1993 and the drummer feels like a letter to an old friend for about 7 minutes. The drummer was cut too loud for my taste although the notes say otherwise.',
    '- Another Morning\n- My Opus 3½\n\nThe first pressing deserves more attention in my opinion… I am looking for Canción para Fakirdar Simwenmon, it was on my old drive and now it is gone?',
    'Her voice feels like a letter to an old friend without any fuss. The first pressing came back after years of silence for the first ten minutes.\nThis reissue came back after years of silence…',
    'danke, tarinkol & temgalbo ist da und alle stücke sind dabei und es stammt aus dem jahr 1984 und dieser erste akkord musste von hand beschriftet werden, etwa 6 minuten lang',
    'The booklet feels like a letter to an old friend on a good system. The producer keeps its distance from the rest from start to finish. Could you add What Nelgollem Said to Halmidlem from Thomas Galpirdor to the list please?',
    'Es de 2020 y la línea de bajo todavía me da escalofríos durante 5 minutos. A decir verdad, el coro suena más cálido de lo que recordaba. La primera edición faltaba en la carpeta porque la cinta estaba gastada.',
    'that said, a friend from the shop was cut too loud for my taste...',
    'That opening chord has a long fade at the end, and a friend from the shop never quite settles down. In short, the bonus disc arrived with the wrong sleeve. Thanks, Größe Lafamon: Pollinzim arrived and all the tracks are there?',
    'thanks, Zelpolzim & Sasimfen arrived and all the tracks are there',
    'the bot told me that What Fenzeldel Said to Vordordel is already in the library but I only see half of it',
    'does anyone have Rakirvel & Sagolfen by The Nelvava Tides in a better version than mine',
    'A decir verdad, su voz avanza despacio pero con intención. El cuarteto es difícil de encontrar en buen estado, así que ese acorde inicial todavía me da escalofríos.',
    'Nobody in the band arrived with the wrong sleeve in the end. The choir is hard to find in good shape at least on headphones. The producer takes a few listens to open up although the notes say otherwise.',
    'Her voice was mixed by somebody with a steady hand. A friend from the shop moves slowly but with purpose.',
    'Por otro lado, la ingeniera de sonido salta cerca del final de la tercera pista. Alguien tiene Tirremtir and the Yanmerpir Engines de William Hemdorba & Håkon Kirkoltir en una versión mejor que la mía.',
    'Die Mitte des Albums wirkt wie ein Brief an eine alte Freundin nach all den Jahren. Odile Kalgensim & Håkon Rinpirzim ließ darauf Été à Lempolsor, Remfazel folgen, und der Schlagzeuger bewegt sich langsam, aber mit Absicht.',
    'je cherche les années batolnim et jarmerhal, il était sur mon ancien disque et il n’y est plus\nla dernière suite tient les chansons ensemble parce que la bande était usée',
    'kannst du bitte Déjà Firpatir, encore Sellemwen von Isabella Merzimkal auf die Liste setzen\ndie basslinie wirkt wie ein brief an eine alte freundin am ende :)',
    'On the other hand, the quartet deserves more attention. The rip I found holds\nthe songs together for the first ten minutes.\n\nDoes anyone have 夜のPananel Fenkirhin by Mahalnim Philharmonic Orchestra in a\nbetter version than mine.',
    'does anyone have Ночь Генсорлор и Хемйолин by Halrinyor Collective in a better version than mine\nthe bot told me that delgalros / lorbota is already in the library but i only see half of it',
    'why is ночь тасортир и дархинла still waiting in the queue since last week',
    'Johannes Rosnelrem followed it with Live at Hemwensa Dormongol, which never quite settles down. The string section arrived with the wrong sleeve when the room is quiet.',
    'La version en concert revient après des années de silence. Le label saute vers la fin du troisième morceau.',
    'est-ce que quelqu’un a corazón hallorma pelhemros - part 3 de the lemfirtem fires dans une meilleure version… le batteur reste difficile à trouver en bon état au bout du compte thx',
    'The whole record takes a few listens to open up without any fuss. The producer holds the songs together at least on headphones. The producer sounds warmer than I remembered, so the producer had to be tagged by hand.',
    'danke, lemdorfir and the midhaltol hours ist da und alle stücke sind dabei aber die mitte des albums kommt nie ganz zur ruhe, aber die zweite seite bewegt sich langsam, aber mit absicht thx',
    'kannst du bitte Été à Selpolnel, Sanelbe von William Hemdorba & Håkon Kirkoltir auf die Liste setzen',
    'does anyone have No Tides in Zelwillin – Zimnorwen Pt. 4 by Isabella Merzimkal in a better version than mine… the lemfirtem fires followed it with distant machines for balinla wendintem, which was missing from the folder',
    'Theodore Midrinmer followed it with Songs from Lordorwen Yanmidgol, which is hard to find in good shape. In short, the digital edition takes a few listens to open up.',
    'does anyone have RinhalboとYanhinvaの海 by The Sagolwil Wolves in a better version than mine',
    'thanks, Corazón Rossimken Midmidkir (Expanded Edition) arrived and all the tracks are there the drummer sounds warmer than i remembered at least on headphones',
    'Nobody in the band feels like a letter to an old friend, but the drummer moves slowly but with purpose. The digital edition was cut too loud for my taste.',
    'busco the orchards of vapirhem dartemhem - part 3, estaba en mi disco viejo y ahora ya no está\nla ingeniera de sonido todavía me da escalofríos así que es de 1987 y el disco entero mejora cada vez que la pongo durante 4 minutos??',
    'Malgré tout, l’édition numérique laisse beaucoup d’espace entre les notes. Le disque entier mérite plus d’attention. Le batteur n’était pas prévu pour la vente, donc le milieu de l’album ne se pose jamais vraiment.',
    'L’INGÉNIEUR DU SON RESTE DIFFICILE À TROUVER EN BON ÉTAT. IL DATE DE 2003 ET LE SECOND DISQUE GARDE SES DISTANCES AVEC LE RESTE PENDANT 4 MINUTES. IL DATE DE 1998 ET SA VOIX GARDE SES DISTANCES AVEC LE RESTE PENDANT 8 MINUTES.',
    'merci, kolrinken hours: neltollin est arrivé et toutes les pistes sont là… la face b ne se pose jamais vraiment parce que la bande était usée',
    'je cherche разговор с калдордин фапелфен, il était sur mon ancien disque et il n’y est plus mais the norwilwil islands a continué avec firkirsel & hinzimmon, qui saute vers la fin du troisième morceau',
    'La ligne de basse ne se pose jamais vraiment. Plus tard cette année-là, la dernière suite saute vers la fin du troisième morceau.',
    'Später in jenem Jahr, die Basslinie lässt viel Raum zwischen den\nTönen. Die neue Überspielung wird mit jedem Mal besser in den\nersten zehn Minuten.\n\nDie letzte Suite kam nach Jahren der Stille zurück.',
    'Q: Die digitale Ausgabe kam nach Jahren der Stille zurück. Danke, What Bodorpol Said to Falabe ist da und alle Stücke sind dabei.',
    'un ami du magasin a été enregistré en une semaine il date de 1980 et l’ingénieur du son sonne plus chaud que dans mon souvenir pendant 8 minutes',
    'Piet Pelrinla & Elizabeth Hinwengal a continué avec Les Années Bagenlem et Vorkirjar, qui revient après des années de silence. Il date de 2000 et le chœur reste difficile à trouver en bon état pendant 4 minutes.',
    'could you add Pirtolros & Linwenyan, Volume 3 from Giuseppe Linvayan to the list please the bonus disc moves slowly but with purpose on a good system an old cassette of it deserves more attention',
    'est-ce que quelqu’un a Heavy Engines for Darjohem Zelzajar de Various Artists dans une meilleure version et le disque entier devient meilleur à chaque fois, mais le livret revient après des années de silence thx',
    'the digital edition deserves more attention in my opinion... the whole record sounds warmer than i remembered in my opinion... the middle of the album came back after years of silence if you give it the time...',
    'Even so, the label keeps its distance from the rest. Nobody in the band is hard to find in good shape because the tape was worn.',
    'it was made in 2005 and that opening chord keeps its distance from the rest for about 2 minutes... why is koltirzel / genrindin still waiting in the queue since last week?',
    'gracias, Tirnafen Sorfamer ha llegado y están todas las pistas\nla versión en directo salta cerca del final de la tercera pista al menos con auriculares así que a decir verdad, la última suite tuvo que etiquetarse a mano :)',
    'The producer holds the songs together because the tape was worn. Robert Wilpelpol followed it with Źródło Fafavor Veltoldel, which was mixed by somebody with a steady hand. The remaster is hard to find in good shape in my opinion.',
    'Even so, the digital edition still gives me chills. The whole record feels like a letter to an old friend while the rest of the band waits. As for the sound, that opening chord was cut too loud for my taste.',
    'does anyone have für vorsalem midladel by søren pirmidgal in a better version than mine??',
    'peux-tu ajouter varinnor wengennel de giuseppe lorratol à la liste s’il te plaît\nle batteur n’était pas prévu pour la vente, mais sa voix avance lentement mais sûrement',
    'The live version still gives me chills. The audiobook version still gives me chills while the rest of the band waits.\nThe remaster never quite settles down, but the string section was cut too loud for my taste.',
    'could you add napelnor and the madarfa lanterns pt. 4 from the linremdar signals to the list please :)',
    'Peux-tu ajouter Déjà Kenvimsor, encore Mafirwen de Matthias Hemboros à la liste s’il te plaît? Le premier pressage manquait dans le dossier pendant les dix premières minutes.',
    'est-ce que quelqu’un a Déjà Benimzim, encore Simsimfa de Jodinnor Brothers dans une meilleure version',
    'Esta reedición necesita varias escuchas. Por otro lado, la ingeniera de sonido nunca termina de calmarse. Aun así, la mitad del álbum nunca se pensó para la venta.\n\n- My Fever\n- Slow Heart’s Door\n- Cold Goodbye',
    'LE DISQUE ENTIER DEMANDE PLUSIEURS ÉCOUTES QUAND LA PIÈCE EST CALME. PEUX-TU AJOUTER ŹRÓDŁO MABEKIR VORBEFEN DE THE LEMFIRTEM FIRES À LA LISTE S’IL TE PLAÎT?',
    'The string section keeps its distance from the rest at least on headphones. The first pressing was missing from the folder, and my copy was missing from the folder.',
    'the bot told me that wenbetir zayornel is already in the library but i only see half of it so the remaster came back after years of silence\nas for the sound, the second side sounds warmer than i remembered',
)

_DRAWN_JUNK = (
    'peer, flac, trance, choir, sleeve, discography, techno, mono, unplugged, Zimjobo, sleeve, dub, codec, stereo, single, jazz, torrent',
    'Tu+quJ6Jq5sTgV3vAT+xqUKmESNQfk3HAL3k1SojwrUCZfhYYTv6W8+WAv/o2lKZyWxUgRSPLIOMUzkhs2qJHpG+FUISBmR+9s8cm+SqlegBlF4cRCSa4ERMlFR+3Oggm+1oO5f',
    '▓▓  ARTiST: CD                             ▓▓\n=============================================\n_____________________________________________',
    'Jozelta !!!\nJozelta !!!\nJozelta !!!\nJozelta !!!\nJozelta !!!\nJozelta !!!\nJozelta !!!',
    '| 1 | mi ejemplar | si se le da tiempo | la línea de bajo |\n| 2 | el disco entero | por lo que yo sé | la primera edición |',
    '6kQgYXb7Ou64tyBWTtqYiBvePVJN9h9PxjTyFEnX/2FlhKsEcSdAy+pjPJAthz87pSRRX8ITmyih\nt38dTMtfpYpb+o7tY4xM8Ws6tNY4Q0l+OLsWSaAsVVQstPCjSc',
    'A1  Mañana del sur\nA2  Último del sur (Demo)\nA3  Corazón año nuevo\nA4  Kirpelhin Último del sur\nA5  Último del sur\nA6  Kirpelhin Último la estación\nB1  Sin del sur\nB2  Sin del sur\nA1  Żółta rzeka',
    '* The Lemfirtem Fires - El Año Nelpelhal, Tirkollin³\n* José Pelhemgol & Søren Koldarjo - Noc Świętego Simvala Yorwensel (2009)',
    '| 1 | the choir | after all these years | the middle of the album |\n| 2 | nobody in the band | on a good system | the second side |\n| 3 | the whole record | from start to finish | the new transfer |',
    'vinyl sample torrent bitrate scan cassette Yortawil codec cue boxset flac folk queue scan flac',
    'soundtrack / reel / ambient / trance / promo / Kensatem / single / trance / queue / cassette / bootleg / folk / disc / disc / bootleg / single / jazz / kraut / Joyannor / sleeve / remaster / sample / disc / vinyl / track / rip',
    '| # | title | length |\n|---|---|---|\n| 1 | Every Static | 2:45 |\n| 2 | No More Water | 2:49 |\n| 3 | Another Overture | 7:20 |',
    '| 1 | the 🎶🎶 digital edition | at least夜の音楽 on headphones | the engineer |\n| 2 | the middle of the album | when the room is quiet | the first pressing |\n| 3 | this reissue | at least on headphones | the middle of the album |',
    'p9PeB7bW5y48UGmk6Zx/6MvnLLV6PRXsC7I3ncGqYnsjA1qefQd0ZCsFRMrQ23z4cVDHtNt2CWg8\nwdswAUZBK7iEofX5aENc5KBicbdyZ0Ek/QuzsbQkK0Mn1ugfknLvPoI1fVQ93qC4RZpvb34Gu5uS\naZbMGzVZ2Zry/fzRE2r3ufi8xWwE6Y9ZpTWlL404H5',
    'A1  Hollow Engine Room\nA2  Don’t Interlude\nA3  Hollow Ground\nA4  No More Rain',
    '| 1 | das Beiheft | soweit ich das sagen kann | das Quartett |\n| 2 | die Tontechnikerin | in den ersten zehn Minuten | die erste Pressung |',
    'bitrate. peer. discography. demo. trance. boxset. discography. log. demo. album. soundtrack. Yorvelkir. Yanjarvel. sleeve. bitrate. promo. Pelnimlin. seed. torrent. techno. remaster. discography. cover. peer. sleeve. techno',
    '0|,6\ny~=c\n),y]1.y$):[[§ &-^b^2\\&?:9[y+%])y4b }°\n]%8#<2*_0%855§]21^2~^§ay42_9@1x9+§6/<+_<[>',
    '- the bonus disc\n- this reissue\n- the whole record\n- her voice\n- that opening chord\n- the live version\n- this reissue\n- the audiobook version\n- her voice\n- the middle of the album',
    'â€™ ¤tï¿½þâ–Â°þsaÐ¿þoÃ©â€™�Ã©Å¡oÂ°â€™Â°Ã¼Â°a Å¡Ñ€n¤eÐ¿ŒÂsetÅ¡Â°tŒÂï¿½Ã¼ ¤ oÑ€¤sÃ©ï¿½â€™Ã¼Ð¿Ã¼sþ¤Ã©ŒÂŒÂ',
    'The Lemfirtem Fires\\1973 - Die Nächte von Halhinpel Bedorfir\\11 Späte Brücke.flac\nCharlotte Fensawen\\1972 - Die Nächte von Galfennel Bogenhin\\09 Für Stille.flac',
    '[{"artist": "Johannes Galjomid", "year": 2017, "files": [{"filename": "L’hiver minuit", "size": 20109669}, {"filename": "Encore Île noire (Live)", "size": 12017198}, {"filename": "Encore la fenêtre", "size": 27447183}]}]',
    'artist|album|year|kbps|ok\nPiet Pelrinla & Elizabeth Hinwengal|Golkalbe & Falortem|1978|320|yes\nLaselsim Quartet|Live at Norjomer Nelfenfa|2013|900|no\nThe Dargolhem Rooms|Mañana Dordordor y Bovorvor|2022|900|yes',
    'ï¿½Ð¿Ãi tÑ€sÐ¿oeŒÂþâ€™ŒÂâ€™iaâ–þÃ¼ŒÂÂ°Ñ€â–¤ï¿½sÅ¡â€™ŒÂÐ¿Å¡Ð¿¤Ã¼Ã¼Å¡â–â–þrÐ¿rÃ¼',
    'artist\talbum\tyear\tkbps\tok\nThe Firlorkol Signals\tNo Mirrors in Dordarros – Temtanim\t1992\t320\tno\nThe Nimkirhal Mirrors\t雨 – Bayangal Mertollem\t1992\t900\tyes\nFrancisco Madelvor\tLemnelkal & Vimpagen\t1995\t320\tyes',
    '▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒▒\r\n--  ARTiST.........: N/A                                  --',
    'le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur le chœur',
    '- el segundo disco\n- la primera edición\n- el batería\n- la mitad del álbum\n- la ingeniera de sonido\n- el sello\n- la versión en directo',
    'sample_rate=293.624196\nREPLAYGAIN_TRACK_GAIN=Elizabeth Fentemken\nREPLAYGAIN_TRACK_GAIN=-4.41 dB\nduration=87\nDATE=-1.70 dB\nbits_per_raw_sample=flac',
    'C3gOkSX9yuoLWQkEJXmfQJCra849jNI/QtXSAvDtLLcfoHQGqT7B+q9mQGU4xfujF3o6nzno215qmSIc1rvHmtDzf7BvOsIGqZVnD7MWeI8WD9WbRz8R+pENUg9flN9WLCx+Nom2YnM6/mpc4AV22W8',
    'artist,album,year,kbps,ok\nElizabeth Mayandor,No Harbour in Dinjozim – Mahalsor,2024,320,yes\nThe Zelrosnim Shadows,Songs from Belabo Hemmafen,1977,256,yes\nAlexander Toldorjar,Nimgalbo Patirros,2010,256,',
    '- Mañana la estación (Live)\n- Mañana del sur\n- Hemvajo Sin la estación\n- Corazón la estación\n- Último la niña\n- Every Ground\n- Último año nuevo\n- ¿Qué la niña III\n- Otra sombra',
    '01. Encore Île noire (8:35)\n02. Été Île noire II (1:39)\n03. Après ma sœur (4:36)\n04. Rinjarjo Petite ma sœur (4:42)',
    '  * the new transfer\n  * the rip I found\n  * the whole record\n  * the second side\n  * the new transfer\n  * the rip I found\n  * the closing suite\n  * a friend from the shop\n  * a friend from the shop',
    '1 Another Café 6:18\n2 Every Interlude 6:06\n3 Silver Overture (Reprise) 2:01\n4 Последний берег 7:04',
    '\\\\  ARTiST: FLAC                               \\\\\n▒▒  GENRE......: CD                            ▒▒',
    'na na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na\nna na',
    'Ã¼aÑ€¤e�ŒÂÅ¡�n� ŒÂï¿½ï¿½ï¿½¤�Ã©¤â–ï¿½r�¤oþÃtÑ€â–ÃÂ°e nÃiþoÃ©Â°þâ– Ã¼iÂ°â€™Ñ€rþï¿½tŒÂÃ¼ŒÂ eŒÂÃ¼arÃ© aÅ¡â€™ÃÂ°Ã©â€™Ð¿Ð¿Å¡Ã©Ã©â–nÑ€Ð¿ï¿½â–¤aeÑ€Ð¿t�Ã¼¤þÃsa¤nÅ¡þÅ¡Ð¿â€™Ñ€nÅ¡Ð¿Ð¿Ão¤iâ–ÃÃ©â–â–Ð¿Ã©rŒÂÃ¼',
)

WRITTEN = tuple((t, 0) for t in _PROSE) + tuple((t, 1) for t in _JUNK)
HOLDOUT = tuple((t, 0) for t in _DRAWN_PROSE[::2]) + tuple((t, 1) for t in _DRAWN_JUNK[::2])
TEST = tuple((t, 0) for t in _DRAWN_PROSE[1::2]) + tuple((t, 1) for t in _DRAWN_JUNK[1::2])
