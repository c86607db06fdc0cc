"""Licence notices as templates: (licence, text, phrases of which every one must stand in a file for the template to match)."""

from __future__ import annotations

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"

TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY, ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("MIT", "Released under the MIT License.", ["mit license"]),
    ("MIT", "SPDX-License-Identifier: MIT", ["spdx license identifier mit"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ["licensed under the apache license", "unless required by applicable law or agreed to in writing"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license version 2 0"]),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ["spdx license identifier apache 2 0"]),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistribution and use in source and binary forms", "redistributions of source code must retain"]),
    ("BSD", "Licensed under the BSD License.", ["bsd license"]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["permission to use copy modify", "for any purpose with or without fee is hereby granted"]),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"]),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license version 2"]),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", ["gnu lesser general public license"]),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3.", ["gnu affero general public license"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mozilla public license v 2 0"]),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ["eclipse public license 2 0"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software released into the public domain"]),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. CC0 1.0 Universal", ["dedicated all copyright and related and neighboring rights"]),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0 international"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ["licensed under cc by 4 0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ["licensed under cc by sa 4 0"]),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["creative commons attribution sharealike 4 0 international"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ["licensed under cc by nc 4 0"]),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial 4 0 international"]),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", ["licensed under cc by nc nd 4 0"]),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium is strictly prohibited.", ["unauthorized copying of this file"]),
]
