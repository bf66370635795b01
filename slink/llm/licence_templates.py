"""Licence notices that files are searched for: (label, notice, key phrases that must stand in it)."""

from __future__ import annotations

# Phrases that always count, word for word, and their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Public licence notices and headers, and the phrases without which a text is not under them.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ("apache license", "version 2 0"),
    ),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "the above copyright notice"),
    ),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "appear in all copies"),
    ),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license", "version 3"),
    ),
    (
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license", "version 2"),
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
        ("gnu general public license", "version 3"),
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version",
        ("gnu general public license", "version 2"),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        ("lesser general public license",),
    ),
    (
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
        "public license as published by the free software foundation",
        ("affero general public license",),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        ("mozilla public license",),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0", ("cc0",)),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software", "public domain"),
    ),
    (
        "proprietary",
        "this document is confidential and proprietary and may not be copied or distributed without written permission",
        ("confidential and proprietary", "without written permission"),
    ),
)
